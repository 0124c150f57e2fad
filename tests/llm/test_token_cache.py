"""The cache of token counts: hits, doubled rows, runs tried again, and normalised content."""

import public_tokenizers
import pytest

from gridloom.llm import token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ROWS = [(k, t) for k, t in enumerate(["one two three", "one two three", None, "", "Café  au lait", "café AU lait", "café au lait", "x <|endoftext|> Y", "x <|endoftext|> y", "Café\nau lait "])]


def counts(df, path, cache, **options):
    return sorted(tuple(r) for r in token_counts.count_tokens(df, path, cache, **options).collect())


def brute(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return sorted((k, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t in ROWS)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_doubled_caches_and_later_runs(spark, tmp_path, path):
    df, cache = spark.createDataFrame(ROWS, "doc_id bigint, text string"), str(tmp_path / "cache")
    want = brute(path)
    assert counts(df, path, cache, run="a") == want
    held = spark.read.option("recursiveFileLookup", "true").parquet(cache)
    contents = held.count()
    # words in lower case, white space as one space, composed letters: those texts are one content
    assert contents == len({t or "" for _, t in ROWS}) - (2 if path == WORDS else 0)
    held.write.parquet(f"{cache}/run=twice")  # as two runs at one time do
    assert counts(df, path, cache, run="b") == want
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(f"{cache}/run=b").count() == 0  # nothing was encoded
    assert counts(df, path, cache, run="a") == want  # tried again: its folder is written anew
    assert counts(df.unionByName(df), path, cache) == sorted(want * 2)
    more = spark.createDataFrame([*ROWS, (77, "a new text")], "doc_id bigint, text string")
    assert len(counts(more, path, cache, run="c")) == len(ROWS) + 1
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(f"{cache}/run=c").count() == 1


def test_tokenizers_share_a_cache(spark, tmp_path):
    df, cache = spark.createDataFrame(ROWS, "doc_id bigint, text string"), str(tmp_path / "cache")
    for path in (BYTES, WORDS, BYTES, WORDS):
        assert counts(df, path, cache) == brute(path)
    empty = df.limit(0)
    assert counts(empty, BYTES, str(tmp_path / "other")) == []
