"""Arrays from DataFrames, Python data, and rules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import geometry
from gridloom.errors import ShapeError, UnsupportedError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, unravelled

KINDS = {T.BooleanType: bool, T.ByteType: int, T.ShortType: int, T.IntegerType: int, T.LongType: int, T.FloatType: float, T.DoubleType: float}


@values.plan
def from_dataframe(df: DataFrame, index_cols, value_cols, shape, check: bool = True):
    """Arrays of columns of df, one for each of value_cols (a name, or several, which then share a base and combine
    without joins). Index columns start at 0. Unless check is False, one job makes sure that each cell comes exactly
    once. A null is NaN in a float column and refused in another."""
    names = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    shape = geometry.checked_shape(shape)
    if len(index_cols) != len(shape):
        raise ShapeError("one index column for each axis")
    kinds = {}
    for name in names:
        kind = KINDS.get(type(df.schema[name].dataType))
        if kind is None:
            raise UnsupportedError(f"column {name} has a type without a dtype")
        kinds[name] = kind
    picked = df.select(
        *(F.col(c).cast("bigint").alias(i) for c, i in zip(index_cols, indices(len(shape)))),
        *((F.coalesce(F.col(n).cast("double"), F.lit(values.NAN)) if kinds[n] is float else F.col(n).cast(values.SPARK[kinds[n]])).alias(f"v{k}") for k, n in enumerate(names)),
    )
    if check:
        inside = F.lit(True)
        for i, n in zip(indices(len(shape)), shape):
            inside = inside & F.coalesce((F.col(i) >= 0) & (F.col(i) < n), F.lit(False))
        nulls = F.lit(False)
        for k in range(len(names)):
            nulls = nulls | F.col(f"v{k}").isNull()
        cells = picked.groupBy(*indices(len(shape))).agg(F.count("*").alias("n"), F.bool_or(~inside | nulls).alias("bad")) if shape else picked.agg(F.count("*").alias("n"), F.lit(False).alias("bad"))
        found = cells.agg(F.count("*").alias("cells"), F.coalesce(F.max("n"), F.lit(1)).alias("most"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad")).first()
        if found["cells"] != math.prod(shape) or found["most"] > 1 or found["bad"]:
            raise ShapeError(f"the rows don't hold each cell of shape {shape} exactly once, with a value")
    made = [NDArray(picked, F.col(f"v{k}"), shape, kinds[n], free=True) for k, n in enumerate(names)]
    return made[0] if isinstance(value_cols, str) else made


@values.plan
def grid(spark: SparkSession, shape) -> DataFrame:
    """A row for each cell, with its indices and, as lin, its place."""
    shape = geometry.checked_shape(shape)
    return spark.range(math.prod(shape)).select(*(c.alias(i) for c, i in zip(unravelled(F.col("id"), shape), indices(len(shape)))), F.col("id").alias("lin"))


def full(spark, shape, fill_value, dtype=None) -> NDArray:
    kind = dtype or values.kind_of(fill_value)
    return NDArray(grid(spark, shape), values.constant(fill_value, kind), geometry.checked_shape(shape), kind)


def zeros(spark, shape, dtype=float) -> NDArray:
    return full(spark, shape, 0, values.checked(dtype))


def ones(spark, shape, dtype=float) -> NDArray:
    return full(spark, shape, 1, values.checked(dtype))


@values.plan
def array(spark, obj, dtype=None, shape=None) -> NDArray:
    """From nested sequences, at most 64 deep and not ragged; the kind is that of the highest leaf, bool if none. A scalar
    takes a shape and fills it; sequences have their own."""
    if not isinstance(obj, (list, tuple)) and shape is not None:
        kind = values.kind_of(obj)
        if dtype and values.promote(kind, values.checked(dtype)) is not dtype:
            raise values.DTypeError(f"cannot narrow {values.NAMES[kind]} to {values.NAMES[dtype]}")
        return full(spark, shape, obj, dtype)
    if shape is not None:
        raise ShapeError("only a scalar takes a shape")
    shape, leaves, level = [], obj, obj
    while isinstance(level, (list, tuple)):
        if len(shape) == 64:
            raise ShapeError("nested sequences exceed the maximum depth of 64")
        shape.append(len(level))
        level = level[0] if level else None
    if not shape:
        if isinstance(obj, values.ORDER):
            raise ShapeError("0-dimensional arrays cannot be created: a scalar needs a shape")
        raise values.DTypeError("expected nested list/tuple")
    leaves = [obj]
    for n in shape:
        if any(not isinstance(x, (list, tuple)) or len(x) != n for x in leaves):
            raise ShapeError("inhomogeneous nested sequence")
        leaves = [y for x in leaves for y in x]
    if any(isinstance(x, (list, tuple)) for x in leaves):
        raise ShapeError("inhomogeneous nested sequence")
    found = values.promote(bool, *(values.kind_of(x) for x in leaves))
    kind = values.checked(dtype) if dtype else found
    if values.promote(found, kind) is not kind:
        raise values.DTypeError(f"cannot narrow {values.NAMES[found]} to {values.NAMES[kind]}")
    cells = [(k, {"re": complex(x).real, "im": complex(x).imag} if kind is complex else kind(x)) for k, x in enumerate(leaves)]
    df = spark.createDataFrame(cells, f"lin bigint, v {values.SPARK[kind]}")
    return NDArray.of(df.select(*(c.alias(i) for c, i in zip(unravelled(F.col("lin"), shape), indices(len(shape)))), "v"), shape, kind)


def arange(spark, start, stop=None, step=1) -> NDArray:
    if stop is None:
        start, stop, step = 0, start, 1
    if any(isinstance(x, bool) or not isinstance(x, int) for x in (start, stop, step)):
        raise values.DTypeError("arange takes integers")
    if not step:
        raise ShapeError("arange step must not be zero")
    n = max(0, -((start - stop) // step))
    return NDArray(grid(spark, n), F.lit(start).cast("bigint") + F.col("lin") * F.lit(step).cast("bigint"), (n,), int)


def _line(start: float, stop: float, num: int, endpoint: bool):
    """i / n of the way, the ends exact; opposite signs are mixed so that the difference can't overflow."""
    if num < 0 or not (math.isfinite(start) and math.isfinite(stop)):
        raise ShapeError("linspace bounds must be finite, and num not negative")
    parts = (num - 1 if endpoint else num) or 1
    share = F.col("lin") / F.lit(float(parts))
    inner = F.lit(start) * (1 - share) + F.lit(stop) * share if (start < 0) != (stop < 0) else F.lit(start) + F.lit(stop - start) * F.col("lin") / F.lit(float(parts))
    line = F.when(F.col("lin") == 0, F.lit(start))
    if endpoint and num > 1:
        line = line.when(F.col("lin") == num - 1, F.lit(stop))
    return line.otherwise(inner)


def linspace(spark, start, stop, num, endpoint=True) -> NDArray:
    return NDArray(grid(spark, num), _line(float(start), float(stop), num, endpoint), (num,), float)


def logspace(spark, start, stop, num, endpoint=True, base=10.0) -> NDArray:
    if not (math.isfinite(base) and base > 0):
        raise ShapeError("logspace base must be finite and greater than zero")
    return NDArray(grid(spark, num), F.pow(F.lit(float(base)), _line(float(start), float(stop), num, endpoint)), (num,), float)


def geomspace(spark, start, stop, num, endpoint=True) -> NDArray:
    if not start or not stop or (start < 0) != (stop < 0):
        raise ShapeError("geomspace bounds must have the same sign and not be zero")
    sign = -1.0 if start < 0 else 1.0
    inner = F.lit(sign) * F.exp(_line(math.log(abs(start)), math.log(abs(stop)), num, endpoint))
    value = F.when(F.col("lin") == 0, F.lit(float(start)))
    if endpoint and num > 1:
        value = value.when(F.col("lin") == num - 1, F.lit(float(stop)))
    return NDArray(grid(spark, num), value.otherwise(inner), (num,), float)


def _where(spark, n, m, test, dtype) -> NDArray:
    values.refuse(values.checked(dtype), bool, name="eye and tri")
    return NDArray(grid(spark, (n, m)), F.when(test, values.constant(1, dtype)).otherwise(values.constant(0, dtype)), (n, m), dtype)


def eye(spark, n, m=None, k=0, dtype=float) -> NDArray:
    return _where(spark, n, n if m is None else m, F.col("i1") - F.col("i0") == k, dtype)


def tri(spark, n, m=None, k=0, dtype=float) -> NDArray:
    return _where(spark, n, n if m is None else m, F.col("i1") <= F.col("i0") + k, dtype)


def _triangle(a: NDArray, keep) -> NDArray:
    from gridloom.operators.manipulation import broadcast_to

    a = broadcast_to(a, (a.size, a.size)) if a.ndim == 1 else a
    if a.ndim < 2:
        raise ShapeError("tril and triu take arrays of one or more axes")
    row, col = F.col(f"i{a.ndim - 2}"), F.col(f"i{a.ndim - 1}")
    return NDArray(a.base, F.when(keep(row, col), a.value).otherwise(values.constant(0, a.dtype)), a.shape, a.dtype)


def tril(a: NDArray, k=0) -> NDArray:
    return _triangle(a, lambda r, c: c <= r + k)


def triu(a: NDArray, k=0) -> NDArray:
    return _triangle(a, lambda r, c: c >= r + k)


@values.plan
def diag(a: NDArray, k=0) -> NDArray:
    """A vector on a diagonal of a matrix of zeros, or a diagonal of a matrix."""
    from gridloom.operators.linalg import diagonal

    values.refuse(a.dtype, bool, name="diag")
    if a.ndim == 2:
        return diagonal(a, k)
    if a.ndim != 1:
        raise ShapeError("diag requires a 1-D or 2-D array")
    n = a.size + abs(k)
    cells = a.df.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), F.col("v").alias("x"))
    whole = grid(a.base.sparkSession, (n, n)).drop("lin").join(cells, ["i0", "i1"], "left")
    return NDArray(whole, F.coalesce("x", values.constant(0, a.dtype)), (n, n), a.dtype)


def meshgrid(*arrays: NDArray, indexing: str = "xy") -> tuple:
    """One array for each input, all of the common shape."""
    from gridloom.operators.manipulation import broadcast_to, reshape

    if indexing not in ("xy", "ij"):
        raise ShapeError("indexing must be 'xy' or 'ij'")
    if any(a.ndim != 1 for a in arrays):
        raise ShapeError("meshgrid inputs must be 1-D arrays")
    for a in arrays:
        values.refuse(a.dtype, bool, name="meshgrid")
    kind, n = values.promote(bool, *(a.dtype for a in arrays)), len(arrays)
    place = list(range(n))
    if indexing == "xy" and n > 1:
        place[0], place[1] = 1, 0
    shape = [0] * n
    for a, p in zip(arrays, place):
        shape[p] = a.size
    return tuple(broadcast_to(reshape(a.astype(kind), [a.size if q == p else 1 for q in range(n)]), shape) for a, p in zip(arrays, place))
