"""Stable sorts with NaN last, and sorted distinct values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, linear
from gridloom.operators import ufunc
from gridloom.sources import scratch

#: Cells ranked in one window; of longer slices, cells are dealt out by value first, into about as many buckets as it
#: takes, and blocks of cells. Cuts of a slice found at once, and cuts that a cell is compared with at once.
WINDOW_CELLS, CUTS, STEP = 1 << 16, 1 << 12, 1 << 6
#: Bits of a bucket's number for each round of cuts; the bucket of NaN, which comes last.
ROUND_BITS, LAST = 14, (1 << 62) + 1


def _bounds(cells, keys, v: str, buckets: int, slices: int):
    """keys and cuts, the sorted distinct quantiles of v in each group of keys, as a table that a job makes once: counts and
    ranks must see the same cuts."""
    steps = [k / buckets for k in range(1, buckets)]
    numbers = cells.filter(~F.isnan(v)) if dict(cells.dtypes)[v] == "double" else cells
    found = numbers.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(v, steps, max(1000, 10 * buckets)))).alias("cuts"))
    return scratch.held(found, slices * buckets)


def _small(df, rows: int):
    return F.broadcast(df) if rows <= ufunc.BROADCAST_CELLS else df


def _rounds(slice_cells: int) -> int:
    need = 2 * -(-slice_cells // WINDOW_CELLS)
    return 1 if need <= CUTS else 1 + _rounds(-(-2 * slice_cells // CUTS))


def _dealt(cells, keys, v: str, slice_cells: int, slices: int, name: str):
    """cells with a bucket, in the order of v, under that name: an even one lies between two cuts, an odd one holds the cells that
    equal a cut, or are NaN. The cuts of each slice meet its cells as rows: first every STEP-th of them, then those that follow it,
    so that neither the plan nor a row grows with the slice."""
    need = 2 * -(-slice_cells // WINDOW_CELLS)
    buckets = min(need, CUTS)
    bounds, column = _bounds(cells, keys, v, buckets, slices), F.col(v)
    groups = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size("cuts") - 1, F.lit(STEP)).cast("int")), lambda g: F.slice("cuts", g * STEP + 1, STEP))
    some = bounds.filter(F.size("cuts") > 0).select(*keys, groups.alias("groups"))
    heads = some.select(*keys, F.transform("groups", lambda g: g[0]).alias("heads"))
    parts = some.select(*keys, F.posexplode("groups").alias("part", "near"))
    count = lambda array: F.size(F.filter(array, lambda c: c <= column))
    rows = slices * -(-buckets // STEP) * STEP
    if slices == 1 and buckets <= STEP:  # so few that they are a constant
        cuts = [c for r in bounds.select("cuts").collect() for c in r["cuts"] or ()]
        found = cells.select("*", F.lit(0).alias("part"), F.array(*map(F.lit, cuts)).cast(f"array<{dict(cells.dtypes)[v]}>").alias("near"))
    else:
        found = cells.join(_small(heads, rows), keys, "left")
        found = found.withColumn("part", F.greatest(F.coalesce(count("heads"), F.lit(1)), F.lit(1)) - 1).drop("heads")
        found = found.join(_small(parts, rows), [*keys, "part"], "left")
    found = found.withColumn("within", F.greatest(F.coalesce(count("near"), F.lit(0)), F.lit(0)))
    at_cut = (F.col("within") > 0) & (F.get("near", F.col("within") - 1) == column)
    above = (F.col("part") * STEP + F.col("within")).cast("bigint")
    bucket = 2 * above - F.coalesce(at_cut, F.lit(False)).cast("int")
    bucket = F.when(F.isnan(v), F.lit(LAST)).otherwise(bucket) if dict(cells.dtypes)[v] == "double" else bucket
    found = found.withColumn(name, bucket).drop("part", "near", "within")
    if need > CUTS:  # what lies between two cuts is cut again
        part = -(-2 * slice_cells // buckets)
        inner = _dealt(found.filter(F.col(name) % 2 == 0), [*keys, name], v, part, slices * 2 * buckets, f"{name}_")
        step = F.lit(1 << (ROUND_BITS * _rounds(part))).cast("bigint")
        inner = inner.withColumn(name, F.col(name) * step + F.col(f"{name}_")).drop(f"{name}_")
        whole = found.filter(F.col(name) % 2 == 1).withColumn(name, F.when(F.col(name) == LAST, F.lit(LAST)).otherwise(F.col(name) * step + 1))
        found = inner.unionByName(whole)
    return found


def _placed(dealt, keys, own, order, n: int):
    """dealt (n rows) with the place of each row within its group of keys. Groups of own, of which there are a few for each window of
    cells, are counted by a job, and the counts are summed up in their order; rows are numbered within their group."""
    groups = 4 * -(-n // WINDOW_CELLS) + 2
    counts = dealt.groupBy(*keys, *own).agg(F.count("*").alias("n"))
    if groups * (len(keys) + len(own)) <= scratch.DRIVER_VALUES:
        found = counts.toPandas().sort_values([*keys, *own])
        found["start"] = found.groupby(keys)["n"].cumsum() - found["n"]
        starts = scratch.made(dealt.sparkSession, found.drop(columns="n"), [*keys, *own, "start"])
    else:  # by runs of the first of own, and within them
        counts = scratch.held(counts, groups * 4).withColumn("run", F.shiftright(F.col(own[0]), 12))
        before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = counts.groupBy(*keys, "run").agg(F.sum("n").alias("n")).select(*keys, "run", before(Window.partitionBy(*keys).orderBy("run")).alias("earlier"))
        within = counts.select(*keys, "run", *own, before(Window.partitionBy(*keys, "run").orderBy(*own)).alias("start"))
        starts = within.join(runs, [*keys, "run"]).select(*keys, *own, (F.col("start") + F.col("earlier")).alias("start"))
    numbered = dealt.withColumn("own", F.row_number().over(Window.partitionBy(*keys, *own).orderBy(*order)))
    return numbered.join(_small(starts, groups), [*keys, *own]).withColumn("at", (F.col("start") + F.col("own") - 1).cast("bigint"))


def _one_slice(cells, lin: str, n: int):
    """(cells, keys) of an array that is one slice: its number is 0 for each place below n."""
    return cells.withColumn("slice", F.call_function("div", F.col(lin), F.lit(max(n, 1)).cast("bigint"))), ["slice"]


def _ranked(cells, n: int, keys=(), slice_cells: int | None = None, rest=()):
    """cells (keys, lin, v, rest) with the place of each in the order of v, then lin, within its group of keys (slice_cells each,
    n in all). Longer slices are cut between quantiles of v; the cells that equal a quantile, which may be very many, are
    dealt out in blocks of lin, so that no task gets them all."""
    keys, slice_cells = list(keys), n if slice_cells is None else slice_cells
    if not keys:
        cells, keys = _one_slice(cells, "lin", n)
    if slice_cells <= WINDOW_CELLS:
        return cells.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("v", "lin")).cast("bigint") - 1)
    dealt = _dealt(cells, keys, "v", slice_cells, max(1, n // slice_cells) if keys != ["slice"] else 1, "bucket")
    block = F.when(F.col("bucket") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.col("lin"), F.lit(WINDOW_CELLS).cast("bigint")))
    return _placed(dealt.withColumn("block", block), keys, ["bucket", "block"], ["v", "lin"], n).select(*keys, "lin", "v", *rest, "at")


@values.plan
def _sorted(a: NDArray, axis, emit_place: bool) -> NDArray:
    values.refuse(a.dtype, complex, name="argsort" if emit_place else "sort")
    dtype = int if emit_place else a.dtype
    if a.dtype is bool:  # false before true, as 0 before 1
        found = _sorted(a.astype(int), axis, emit_place)
        return found if emit_place else found.astype(bool)
    if axis is None:
        cells = _ranked(a.base.select(linear(a.shape).alias("lin"), a.value.alias("v")), a.size)
        return NDArray.of(cells.select(F.col("at").alias("i0"), F.col("lin" if emit_place else "v").alias("v")), (a.size,), dtype)
    axis = geometry.normal_axis(axis, a.ndim)
    keys = [f"i{k}" for k in range(a.ndim) if k != axis]
    cells = _ranked(a.df.withColumnRenamed(f"i{axis}", "lin"), a.size, keys, a.shape[axis])
    return NDArray.of(cells.select(*(F.col("at" if k == axis else f"i{k}").alias(f"i{k}") for k in range(a.ndim)), F.col("lin" if emit_place else "v").alias("v")), a.shape, dtype)


def sort(a: NDArray, axis: int | None = None) -> NDArray:
    """Flat if axis is None."""
    return _sorted(a, axis, False)


def argsort(a: NDArray, axis: int | None = None) -> NDArray:
    return _sorted(a, axis, True)


def _comparable(v, dtype):
    """What cells of one value agree in: all NaN are one, and zeros have no sign."""
    if dtype is complex:
        zero = F.struct(*((F.col("v")[p] + F.lit(0.0)).alias(p) for p in ("re", "im")))
        return F.when(values.is_nan(v, complex), F.struct(F.lit(values.NAN).alias("re"), F.lit(values.NAN).alias("im"))).otherwise(zero)
    return v


@values.plan
def unique(a: NDArray) -> NDArray:
    """Sorted distinct values; all NaN are one. Complex numbers go by real, then imaginary part. A job counts them."""
    return unique_with(a).values


class UniqueResult(NamedTuple):
    """values, and those asked for: the first place in C order and the number of cells of each, and for each cell, in C order, the
    place of its value among values."""

    values: NDArray
    indices: NDArray | None
    inverse: NDArray | None
    counts: NDArray | None


@values.plan
def unique_with(a: NDArray, return_index: bool = False, return_inverse: bool = False, return_counts: bool = False) -> UniqueResult:
    """Sorted distinct values over one base with their first places and counts, and the cells' places among them. A job counts
    the values. Cells of values that a task's share of all cells equals or more meet these few values first, by a broadcast."""
    key = _comparable(F.col("v"), a.dtype).alias("v")
    cells = a.base.select(linear(a.shape).alias("lin"), a.value.alias("v")).select("lin", key)
    found = cells.groupBy("v").agg(F.min("lin").alias("lin"), F.count("*").alias("n"))
    n = found.count()
    # places reach to a.size, so that all are of one slice; bools are two at most
    ranked = _ranked_pairs(found, n, a.size) if a.dtype is complex else _ranked(found, a.size, slice_cells=0 if a.dtype is bool else n, rest=["n"])
    base = ranked.select(F.col("at").alias("i0"), "v", F.col("lin").alias("first"), "n")
    part = lambda wanted, name: NDArray(base, F.col(name), (n,), int, True) if wanted else None
    inverse = None
    if return_inverse:
        places = ranked.select("v", F.col("at").alias("place"), "n")
        if n <= ufunc.BROADCAST_CELLS:
            met = cells.join(F.broadcast(places.drop("n")), "v")
        else:
            hot = places.filter(F.col("n") >= HOT_CELLS).drop("n").withColumnRenamed("place", "hot")  # size / HOT_CELLS at most
            split = cells.join(_small(hot, a.size // HOT_CELLS), "v", "left")
            cold = split.filter(F.col("hot").isNull()).join(places.filter(F.col("n") < HOT_CELLS).drop("n"), "v")
            met = split.filter(F.col("hot").isNotNull()).select("lin", F.col("hot").alias("place")).unionByName(cold.select("lin", "place"))
        inverse = NDArray(met.select(F.col("lin").alias("i0"), "place"), F.col("place"), (a.size,), int, True)
    return UniqueResult(NDArray(base, F.col("v"), (n,), a.dtype, True), part(return_index, "first"), inverse, part(return_counts, "n"))


#: Cells of one value from which unique_with() takes it for a hot one.
HOT_CELLS = 1 << 18


def _ranked_pairs(found, n: int, size: int):
    """Distinct complex v with their place by real, then imaginary part: buckets of real parts, and within each of those of
    imaginary parts, so that one real part may have any number of them."""
    cells, keys = _one_slice(found.select(F.col("v.re").alias("re"), F.col("v.im").alias("im"), "v", "lin", "n"), "lin", size)
    if n <= WINDOW_CELLS:
        return cells.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("re", "im")).cast("bigint") - 1)
    dealt = _dealt(cells, keys, "re", n, 1, "bucket")
    # a real part that is a cut has its own bucket, and is divided by imaginary parts
    alike = F.col("bucket") % 2 == 1
    divided = _dealt(dealt.filter(alike), [*keys, "bucket"], "im", n, 2 * -(-n // WINDOW_CELLS), "inner")
    both = divided.unionByName(dealt.filter(~alike).withColumn("inner", F.lit(0).cast("bigint")))
    return _placed(both, keys, ["bucket", "inner"], ["re", "im"], n)
