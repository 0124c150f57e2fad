"""Token counts through a digest cache.

The digest of a text's content and the digest of the tokenizer's version are the key of a stored table of counts. A
run joins its contents to that table, encodes one text of each content that has no count yet, and appends the counts.
The content is what the tokenizer's own normalizer makes of a text, so that texts which differ only there are one.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.pretokens import pieces

#: Characters of text given to the tokenizer at once, and entries of a task's memo of pieces; both bound memory.
BATCH_CHARS, MEMO_PIECES = 1 << 18, 1_000_000
CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file and of the version of the library that runs it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def loaded(path: str):
    """(count, byte_level, special): a function from texts to their numbers of tokens; whether a text may be cut into
    pieces that are counted apart; and the strings that the library takes for special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False, []
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    cuttable = tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, ByteLevel) and tokenizer.pre_tokenizer.use_regex and not tokenizer.pre_tokenizer.add_prefix_space
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], cuttable, special


_LOADED: dict = {}


def counter(path: str):
    """A function from texts to counts. It remembers the counts of pieces for as long as the worker lives."""
    if path not in _LOADED:
        _LOADED[path] = (*loaded(path), {})
    count, cuttable, special, memo = _LOADED[path]

    def in_batches(texts: list[str]) -> list[int]:
        found, batch, chars = [], [], 0
        for text in texts:
            batch.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                found += count(batch)
                batch, chars = [], 0
        return found + count(batch) if batch else found

    def counts(texts: list[str]) -> list[int]:
        cut = [pieces(t) if cuttable and not any(s in t for s in special) else None for t in texts]
        new = list({p for parts in cut if parts for p in parts if p not in memo})
        whole = [k for k, parts in enumerate(cut) if parts is None]
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = list({p for parts in cut if parts for p in parts})
        memo.update(zip(new, in_batches(new)))
        result = [sum(map(memo.__getitem__, parts)) if parts is not None else 0 for parts in cut]
        for k, n in zip(whole, in_batches([texts[k] for k in whole])):
            result[k] = n
        return result

    return counts


def normalizer(path: str):
    """The function that the tokenizer applies to a text before all else, or None if it takes texts as they are. Texts with
    special strings stay as they are, as those are cut out first."""
    if path.endswith(".model"):
        return None  # its rules are the model's own; equal texts alone are taken for equal
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.normalizer is None:
        return None
    special, normal = [t.content for t in tokenizer.get_added_tokens_decoder().values()], tokenizer.normalizer
    return lambda text: text if any(s in text for s in special) else normal.normalize_str(text)


def digested(text, path: str):
    """The digest of the normalised content of the column text."""
    if normalizer(path) is None:
        return F.sha2(text.cast("binary"), 256)

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        normal = normalizer(path)
        return texts.map(lambda t: hashlib.sha256(normal(t).encode()).hexdigest())

    return digest(text)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", run: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; repeated rows give repeated rows.

    A null text counts as empty; an empty text has 0 bytes and 0 tokens. Rows with a null id are counted too. Other
    columns of docs are not read. cache_path is a folder (made if absent) that outlives runs, for any tokenizers: each run
    adds a Parquet folder of its own there, run=<run>, and writes it anew if it is tried again under the same run id. Runs
    at one time may add a content twice; counts are grouped by content as they are read, so that rows never double.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digested(text, tokenizer_path).alias("content"))

    def cached() -> DataFrame:
        if not cache_exists(spark, cache_path):
            return spark.createDataFrame([], "content string, n_tokens long")
        rows = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(cache_path).filter(F.col("tokenizer") == version)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    one_each = keyed.select("doc_id", "content").groupBy("content").agg(F.min("doc_id").alias("rep"))
    misses = one_each.join(cached(), "content", "left_anti").withColumnRenamed("content", "missed")
    todo = keyed.join(misses.hint("shuffle_hash"), (F.col("content") == F.col("missed")) & F.col("doc_id").eqNullSafe(F.col("rep")))

    def encode(batches):
        counts = counter(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame({"content": batch["content"], "n_tokens": counts(batch["text"].tolist())})

    encoded = todo.select("content", "text").mapInPandas(encode, "content string, n_tokens long")
    (encoded.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
     .select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("overwrite").parquet(f"{cache_path}/run={run or uuid.uuid4().hex}"))
    return (
        keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(cached(), "content", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def cache_exists(spark, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(conf).exists(folder)
