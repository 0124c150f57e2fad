"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, common, decontamination, near_dedup, secrets, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle in the near_dedup stage; op2_near_dedup takes four.
SHINGLE = 5
#: SQL can't say the stages that learn.
ORACLE_SQL = None


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose id decided (doc_id, once each) has; rows without an id stay."""
    ids = common.broadcast_if_small(common.stored(decided.select("doc_id").distinct(), "pipeline-kept"))
    named = docs.filter(F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_semi")
    return named.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, doesn't predict to be toxic."""
    common.small_batches(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return _kept(docs, toxicity.score(docs, model).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    common.small_batches(spark)
    return _kept(docs, near_dedup.near_duplicates(docs, shingle=SHINGLE).filter("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    common.small_batches(spark)
    found = decontamination.scan(docs, common.table(spark, sf_dir, "benchmark"))
    return _kept(docs, found.filter(~F.col("contaminated")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by [SECRET], and n_chars that of the new text."""
    common.small_batches(spark)
    return secrets.redact(docs, secrets.examples_of(docs), ordinary=secrets.ordinary_of(docs)).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    common.small_batches(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("byte_bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
