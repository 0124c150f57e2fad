"""What the operators of this subpackage share: tables, scratch folders, text helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets one of its
    own; on a cluster that is an error, as executors wouldn't find each other's files."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL_ROOTS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of stored(), once no later plan reads them."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


class Stores:
    """Stores tables that a job needs for its own steps alone, and deletes them all at its end."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(stored(df, label))
        return self.tables[-1]

    def drop(self) -> None:
        drop_stored(*self.tables)
        self.tables.clear()


#: Rows of a few numbers that are broadcast at most (about 64 MB); more are joined by shuffles.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a hint to broadcast it, if a count shows that it has few rows; else as it is. Its rows must be narrow."""
    return F.broadcast(df) if df.count() <= rows else df


def release() -> None:
    """Gives a worker's freed memory back to the machine, as far as its allocators can: at the end of a task, as workers
    wait for their next one."""
    gc.collect()
    trim()


def trim() -> None:
    """As release(), but without a search for garbage: for use within a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bounds of the batches that go to Python, so that long texts need little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; an id that is null counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows and characters that one step of map_texts() takes; a longer text is a step by itself.
SLICE_ROWS, SLICE_CHARS = 1000, 1 << 20


def slices(texts: list) -> Iterator[tuple[int, int]]:
    """Starts and ends of stretches of texts that are within those bounds."""
    start = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and (k - start == SLICE_ROWS or size + n > SLICE_CHARS):
            yield start, k
            start, size = k, 0
        size += n
    if texts:
        yield start, len(texts)


def map_texts(docs: DataFrame, work, rest: str, id_col: str, text_col: str, nulls: bool = False, forget=None) -> DataFrame:
    """doc_id and the columns named in rest, a row for each of docs: work takes a list of texts and gives a frame of the
    other columns. A null text is '' to it, or None if nulls. It gets a slice of a batch at a time, so that what it holds
    doesn't grow with Spark's batches. Tasks take a worker's turn, and a worker waits long for its next one: forget, called
    at the end of a task, drops what work remembers. Ids travel as text, so that pandas leaves them alone."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), (text if nulls else F.coalesce(text, F.lit(""))).alias("text"))

    def run(batches):
        try:
            for batch in batches:
                ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
                for start, end in slices(texts):
                    found = work(texts[start:end])
                    found.insert(0, "doc_id", ids[start:end])
                    yield found
        finally:
            if forget:
                forget()
            release()

    out = rows.mapInPandas(run, f"doc_id string, {rest}")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[id_col]))


def contiguous_groups(batches, keys):
    """The groups of frames that come sorted by keys, each whole even where it spans several batches."""
    held: list[pd.DataFrame] = []
    held_key = None
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        changed[0] = True
        for key in keys:
            column = batch[key].to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changed)
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            part = batch.iloc[start:end]
            key = tuple(part[k].iloc[0] for k in keys)
            if held and key != held_key:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held_key = key
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
