"""where, nonzero and clip."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.errors import ShapeError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, linear
from gridloom.operators import ufunc
from gridloom.operators.repeats import elementwise


@elementwise
@values.plan
def where(condition: NDArray, x, y) -> NDArray:
    if not isinstance(condition, NDArray) or condition.dtype is not bool:
        raise values.DTypeError("where condition must be a bool array")
    kind = values.promote(*(v.dtype if isinstance(v, NDArray) else values.kind_of(v) for v in (x, y)))
    whole = [v for v in (condition, x, y) if isinstance(v, NDArray)]
    aligned = iter(ufunc.aligned(*whole))
    c = next(aligned)
    sides = [next(aligned) if isinstance(v, NDArray) else v for v in (x, y)]
    cells = [values.cast(v.value, v.dtype, kind) if isinstance(v, NDArray) else values.constant(v, kind) for v in sides]
    return NDArray(c.base, F.when(c.value, cells[0]).otherwise(cells[1]), c.shape, kind, c.free and all(v.free for v in sides if isinstance(v, NDArray)))


#: Places in a block; the number of true cells before each block gives theirs.
PLACE_BLOCK = 1 << 16


def counted_up(found, size: int):
    """(found, which has places lin, with at, the number of rows before each; the number of rows, by a job). Blocks of places
    are counted and their counts summed up; the rows of a block are numbered within it."""
    from gridloom.operators import reduction

    blocked = found.withColumn("block", F.call_function("div", F.col("lin"), F.lit(PLACE_BLOCK).cast("bigint")))
    counts = blocked.groupBy("block").agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    sums = reduction._scan(counts.select(F.col("block").alias("at"), F.col("n").alias("x"), F.lit(True).alias("ok"), "n"), [], max(1, -(-size // PLACE_BLOCK)), int, False)
    starts = sums.select(F.col("at").alias("block"), (F.col("x") - F.col("n")).alias("start"))
    starts = F.broadcast(starts) if size // PLACE_BLOCK <= ufunc.BROADCAST_CELLS else starts
    own = F.row_number().over(Window.partitionBy("block").orderBy("lin"))
    return blocked.withColumn("own", own).join(starts, "block").withColumn("at", (F.col("start") + F.col("own") - 1).cast("bigint")).drop("block", "own", "start"), n


@values.plan
def nonzero(a: NDArray) -> tuple[NDArray, ...]:
    """The indices of the true cells in C order, an array for each axis, over one base. A job counts them."""
    if not a.ndim:
        raise ShapeError("nonzero takes arrays of one or more axes")
    found = a.base.filter(values.truth(a.value, a.dtype)).select(linear(a.shape).alias("lin"), *(F.col(i).alias(f"x{k}") for k, i in enumerate(indices(a.ndim))))
    placed, n = counted_up(found, a.size)
    base = placed.select(F.col("at").alias("i0"), *(f"x{k}" for k in range(a.ndim)))
    return tuple(NDArray(base, F.col(f"x{k}"), (n,), int) for k in range(a.ndim))


@values.plan
def masked(a: NDArray, mask: NDArray) -> NDArray:
    """The cells of a where mask, of its shape, is true, in C order. Over one base it is filtered once, without a join."""
    x, m = ufunc.aligned(a, mask)
    placed, n = counted_up(x.base.filter(m.value).select(linear(x.shape).alias("lin"), x.value.alias("v")), x.size)
    return NDArray.of(placed.select(F.col("at").alias("i0"), "v"), (n,), a.dtype)


@elementwise
def clip(a: NDArray, min=None, max=None) -> NDArray:
    """min first, then max; NaN passes through; bounds take the array's dtype."""
    values.refuse(a.dtype, complex, name="clip")
    if any(isinstance(bound, (NDArray, list, tuple)) for bound in (min, max)):
        raise ShapeError("clip bounds must be scalar values")
    v = a.value
    if min is not None:
        low = values.constant(min, a.dtype)
        v = F.when(values.COMPARE["less"](v, low, a.dtype), low).otherwise(v)
    if max is not None:
        high = values.constant(max, a.dtype)
        v = F.when(values.COMPARE["greater"](v, high, a.dtype), high).otherwise(v)
    return NDArray(a.base, v, a.shape, a.dtype, a.free)
