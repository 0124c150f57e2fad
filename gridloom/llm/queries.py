"""The queries of this subpackage over the tables of a folder, with production parameters, and SQL where it can say them."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, common, decontamination, html_extraction, language_id, lm_scoring, near_dedup, packing, secrets, spelling, token_counts, topk, toxicity, whitening


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.examples_of(docs), ordinary=secrets.ordinary_of(docs))
    base = F.filter("spans", lambda s: s["kind"] != "format")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "best_odds",
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(common.table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a folder that outlives runs if the session names one; else every run counts all texts anew
    cache = spark.conf.get("spark.gridloom.tokenCounts", None) or common.scratch_path(spark, "token-counts")
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _prepared(query):
    """The query under the session's bounds of batches for Python, which stay set: its plan runs later."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _prepared(f)
    for f in (
        op1_secrets, op2_near_dedup, op3_lm_scoring, op4_token_counts, op5_decontamination, op6_html_extraction, op7_language_id, op8_topk, op9_toxicity, op10_byte_bpe,
        op11_whitening, op12_spelling, op13_packing,
    )
}

LOWER = f"translate({{}}, '{common.UPPER}', '{common.LOWER}')"

ORACLE_SQL = {
    "op2_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k : k + 3], ' ')) END)) AS shingle FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     links AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * b.n >= 80 * (p.n + q.n - b.n)),
     reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
     c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
     p AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k : k + 9], ' '))) AS window FROM i WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT size FROM p),
     t AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS begin_at, w FROM d, sizes WHERE len(w) >= size),
     o AS (SELECT doc_id, begin_at, t.size, item_id FROM t JOIN p ON p.size = t.size AND p.window = array_to_string(w[begin_at : begin_at + t.size - 1], ' ')),
     h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(begin_at, begin_at + size)) AS place FROM o) GROUP BY 1),
     f AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
""",
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    # crc32 byte by byte, by the table that the polynomial gives
    "op12_spelling": rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS t),
     r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
     d AS (SELECT id, run, count(*) AS n FROM r WHERE len(run) >= 5 GROUP BY 1, 2),
     b AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM d),
     h AS (SELECT run, n, xor(list_reduce(range(len(x) // 2), lambda c, k: xor(c // 256, t.t[1 + xor(c, CAST('0x' || x[2 * k + 1 : 2 * k + 2] AS BIGINT)) % 256]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, t),
     c AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM h),
     w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE len(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
     p AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS k FROM w),
     g AS (SELECT word, n, k, word[: k - 1] AS a, word[k + 1 :] AS z FROM p),
     pairs AS (SELECT x.word, y.word AS near, y.n FROM g x JOIN g y ON x.k = y.k AND x.a = y.a AND x.z = y.z AND x.word <> y.word
               UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.a || g.z UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.a || g.z),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS rank, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
     f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN near END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
           FROM w LEFT JOIN ranked r ON r.word = w.word AND rank = 1),
     walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
     roots AS (SELECT walk.word, root FROM walk JOIN f ON f.word = root WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN roots ON roots.word = f.word
""",
}
