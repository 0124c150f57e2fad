"""Tables that a plan reads more than once and must see alike each time."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Values of a table that goes by the driver at most; larger ones are written to the shared folder.
DRIVER_VALUES = 100_000

_LOCAL_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or for a local session without it a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {spark.sparkContext.master} share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL_ROOTS[application]


def made(spark: SparkSession, frame, columns) -> DataFrame:
    """A table of the bigint columns of a pandas frame."""
    return spark.createDataFrame(pa.Table.from_pandas(frame[list(columns)].astype("int64"), preserve_index=False))


def held(df: DataFrame, size: int) -> DataFrame:
    """The rows of df, settled by a job: through the driver if they have few values, else by a written table."""
    if size <= DRIVER_VALUES:
        return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    path = f"{root(df.sparkSession)}/gridloom/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
