"""Queries against SQL on whole tables, texts of megabytes, and the pipeline on small tables with odd rows."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gridloom.llm import byte_bpe, common, decontamination, html_extraction, language_id, lm_scoring, near_dedup, secrets, token_counts, toxicity
from gridloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = ", ".join(sorted(df.columns))
    want = con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert len(got) > 40 and Counter(got) == Counter(want)


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of 2 MB and more beside a short one."""
    rng = np.random.default_rng(31)
    words = np.array([f"word{k}" for k in range(900)] + ["été", "the", "and"])
    text = " ".join(rng.choice(words, 300_000))
    end = " one two three four five six seven eight nine ten token=abcdefgh99 you idiot"
    texts = {0: text + end, 1: text + end + " more", 2: "short one", 3: "x" * 40_000 + " " + text[:2_000_000]}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")


def test_megabyte_texts(spark, long_docs, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    texts, df = long_docs
    assert min(len(texts[k]) for k in (0, 1, 3)) > 2_000_000
    spans = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in secrets.scan(df, secrets.examples_of(df)).collect()}
    assert spans == {0: [("assign", "token=abcdefgh99")], 1: [("assign", "token=abcdefgh99")], 2: [], 3: []}
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.scan(df, bench).collect()}
    assert hits[0] == (300_014, 10) and hits[1] == (300_015, 10) and hits[2] == (2, 0) and hits[3][1] == 0
    groups = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_dedup.near_duplicates(df).collect()}
    split = texts[0].split()
    assert groups[0] == (0, len({tuple(split[k : k + 4]) for k in range(len(split) - 3)})) and groups[1][0] == 0 and groups[2][0] == 2
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for r in byte_bpe.round_trip(df.filter("doc_id <> 3"), RANKS, PATTERN).collect():
        ids = np.array(encoding.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(df, path, str(tmp_path / "cache")).collect():
        assert r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False)) and r["over_limit"] == (r["n_tokens"] > 512)
    scored = {r["doc_id"]: r for r in lm_scoring.score(df).collect()}
    assert {k: r["n_tokens"] for k, r in scored.items()} == {k: len(t.split()) + 1 for k, t in texts.items()} and all(math.isfinite(r["score"]) for r in scored.values())
    model = toxicity.Model([b"idiot"], np.array([3.0]), -1.0)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    langs = language_id.train(df.selectExpr("doc_id + 1 AS doc_id", "text", "if(doc_id = 2, 'xx', 'en') AS lang"))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, langs).collect() if r["doc_id"] < 2} == {0: "en", 1: "en"}
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{texts[0]}.</p></article></body></html>"
    field = html_extraction.train(spark.createDataFrame([(1, "u", "<article><p>Some text of a page.</p></article>")], "page_id int, url string, html string"))
    assert html_extraction.main_text(page, field) == f"Head\n\n{texts[0]}."


CLEAN = "a plain sentence about rivers and hills number {} with many words that differ {} from the others here {}"
BENCH = "which of these nine planets is the one that the old sailors named first of all"


@pytest.fixture(scope="module")
def small_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    base = "the quick brown fox jumps over the lazy dog while seven grey geese fly south for winter and never look back at the cold lake below them"
    rows = [(k, CLEAN.format(k, k * 7, k * 13)) for k in range(40)]
    rows += [(100 + k, f"{CLEAN.format(k, k * 5, k * 11)} you filthy idiot scum go away") for k in range(40)]
    rows += [(200, base), (201, base.upper()), (202, base + " today"), (203, None), (204, ""), (205, base), (206, f"we ask {BENCH} today"), (207, "my token = abcdefgh12345 is here"), (203, None), (207, "my token = abcdefgh12345 is here"), (None, "no id and no name"), (None, None)]
    documents = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, int(100 <= i < 200)) for i, _ in rows if i is not None and i < 200] + [(5, 1, None), (None, 0, 1), (0, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (None, "rivers and hills")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_pipeline_on_odd_rows(spark, small_folder):
    import tiktoken

    folder, rows = small_folder
    docs = common.table(spark, folder, "documents")
    texts = dict(rows)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "byte_bpe"]
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        left[name] = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()), key=str)
    ids = lambda name: sorted({i for i, _, _ in left[name] if i is not None})
    assert ids("toxicity") == sorted(i for i in texts if i is not None and not 100 <= i < 200)
    # brute force over what toxicity left, in shingles of five words
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (texts[i] or "").lower().split()) else set() for i in ids("toxicity")}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert ids("near_dedup") == [i for i in sorted(root) if root[i] == i] and {201, 202, 205}.isdisjoint(ids("near_dedup"))
    assert ids("decontamination") == [i for i in ids("near_dedup") if i != 206]
    assert left["secrets"] == sorted(((i, t and t.replace("token = abcdefgh12345", "[SECRET]"), n if t is None else len(t.replace("token = abcdefgh12345", "[SECRET]"))) for i, t, n in left["decontamination"]), key=str)
    assert [i for i, _, _ in left["secrets"]].count(None) == 2 and [i for i, _, _ in left["secrets"]].count(207) == 2
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    want = sorted(((i, len(encoding.encode_ordinary(t or ""))) for i, t, _ in left["secrets"]), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder).collect()), key=str) == want


def test_pipeline_on_an_empty_table(spark, small_folder):
    folder, _ = small_folder
    docs = common.table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0


def test_folds_are_those_of_the_contracts(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id bigint")
    for r in df.withColumn("x", common.remainder(df["doc_id"], 10)).collect():
        assert r["x"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId = "x"

        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    with pytest.raises(ValueError):
        common.scratch_root(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        common.scratch_root(Session("local-cluster[3,2,1024]"))
    assert os.path.isdir(common.scratch_root(Session("local[4]")))
