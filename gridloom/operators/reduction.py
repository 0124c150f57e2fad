"""Reductions over axes, and cumulative scans.

A reduction groups by the kept axes, so Spark sums up within tasks before it shuffles. Empty axes are settled on the
driver, where shapes are known: an identity, or an error where there is none. A reduction to a single cell gives a
Python scalar, by a job, unless lazy asks for the array without axes.
"""

from __future__ import annotations

from math import prod as product

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.errors import ShapeError, UnsupportedError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, linear, unwrapped

#: Cells of a slice scanned in one window, and cells multiplied in one fold; more are taken as blocks of so many, and the
#: blocks' results in turn.
SCAN_BLOCK, FOLD_BLOCK = 1 << 16, 1 << 12
#: Cells of a slice up to which running products are taken of many slices at a time.
SHORT_RUN = 64
#: Reductions to which repeated cells add nothing; a sum grows by their number.
ONCE = ("sum", "min", "max", "mean", "var", "std", "any", "all")


def _named(axis, axes):
    """What axis or axes say; not both."""
    if axis is not None and axes is not None:
        raise ShapeError("cannot specify both axis and axes")
    return axis if axes is None else tuple(axes)


def _kept(a: NDArray, axis, keepdims: bool):
    axes = geometry.normal_axes(axis, a.ndim)
    kept = [k for k in range(a.ndim) if k not in axes]
    shape = [1 if k in axes else n for k, n in enumerate(a.shape)] if keepdims else [a.shape[k] for k in kept]
    return axes, kept, tuple(shape)


def _policy(nan_policy):
    if nan_policy not in ("propagate", "ignore"):
        raise ShapeError("nan_policy must be 'propagate' or 'ignore'")
    return nan_policy == "ignore"


@values.plan
def _reduce(a: NDArray, axis, keepdims, dtype, make, identity, name) -> NDArray:
    """make(v) is the aggregate over the column v, or make a function of the cells and the kept columns that gives those
    with v; identity None means that an empty slice is an error."""
    axes, kept, shape = _kept(a, axis, keepdims)
    spark = a.session
    if a.repeats and name in ONCE:  # what repeats is reduced once
        from gridloom.operators import manipulation, repeats

        alone = repeats.narrow(a)
        found = _reduce(alone, axes, True, dtype, make, identity, name)
        times = product(a.shape[k] // alone.shape[k] for k in axes)
        if name == "sum" and times > 1:
            v, n = found.value, F.lit(times)
            found = NDArray(found.base, F.struct((v["re"] * n).alias("re"), (v["im"] * n).alias("im")) if dtype is complex else v * n, found.shape, dtype, found.free)
        whole = tuple(1 if k in axes else n for k, n in enumerate(a.shape))
        found = repeats.stretched(found, whole) if found.shape != whole else found
        return found if keepdims else manipulation.reshape(found, shape)
    if product(a.shape[k] for k in axes) == 0 or product(shape) == 0:
        if product(shape) and identity is None:
            raise ShapeError(f"{name} of empty array / empty axis")
        from gridloom.sources.creation import full

        return full(spark, shape, identity if identity is not None else 0, dtype)
    columns = [f"i{k}" for k in kept]
    if name == "prod":
        at = linear([a.shape[k] for k in axes], [f"i{k}" for k in axes])
        found = make(a.base.select(*columns, at.alias("at"), a.value.alias("v")), columns, product(a.shape[k] for k in axes))
    else:
        found = a.base.select(*columns, a.value.alias("v")).groupBy(*columns).agg(make(F.col("v")).alias("v"))
    if keepdims:
        found = found.select(*((F.col(f"i{k}") if k in kept else F.lit(0).cast("bigint")).alias(f"i{k}") for k in range(a.ndim)), "v")
    else:
        found = found.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)), "v")
    return NDArray.of(found, shape, dtype)


def _numbers(a: NDArray):
    """What sums and products work on: bool counts as int."""
    kind = int if a.dtype is bool else a.dtype
    return a.astype(kind), kind


def _skipping(total, v, kind, ignore):
    """total(v) over the cells that aren't NaN, NaN if there are none."""
    if not ignore or kind in (bool, int):
        return total(v)
    nan = values.is_nan(v, kind)
    nothing = values.constant(complex(values.NAN, values.NAN), complex) if kind is complex else F.lit(values.NAN)
    return F.when(F.bool_and(nan), nothing).otherwise(total(F.when(~nan, v)))


def _sum(v, kind):
    return F.struct(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im")) if kind is complex else F.sum(v)


def sum(a: NDArray, axis=None, keepdims=False, nan_policy="propagate", axes=None, lazy=False):
    ignore, (b, kind) = _policy(nan_policy), _numbers(a)
    return unwrapped(_reduce(b, _named(axis, axes), keepdims, kind, lambda v: _skipping(lambda x: _sum(x, kind), v, kind, ignore), 0, "sum"), lazy)


def prod(a: NDArray, axis=None, keepdims=False, nan_policy="propagate", axes=None, lazy=False):
    """Floats multiply within tasks; integers (which wrap) and complex numbers in blocks of a slice, in C order, and then the
    blocks' products in turn."""
    ignore, (b, kind) = _policy(nan_policy), _numbers(a)
    one = values.constant(1, kind)

    def blocks(cells, columns, n):
        if kind is float:
            return cells.groupBy(*columns).agg(_skipping(F.product, F.col("v"), kind, ignore).alias("v"))
        nan = values.is_nan(F.col("v"), kind)
        cells = cells.select(*columns, "at", (F.when(nan, one).otherwise(F.col("v")) if ignore else F.col("v")).alias("v"), (~nan).alias("ok"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"])
        while True:
            block = F.call_function("div", F.col("at"), F.lit(FOLD_BLOCK).cast("bigint")).alias("block")
            cells = cells.groupBy(*columns, block).agg(F.aggregate(listed, one, lambda x, y: values.multiply(x, y, kind)).alias("v"), F.bool_or("ok").alias("ok")).withColumnRenamed("block", "at")
            n = -(-n // FOLD_BLOCK)
            if n == 1:
                break
        nothing = values.constant(complex(values.NAN, values.NAN), complex) if kind is complex else one
        return cells.select(*columns, F.when(F.col("ok"), F.col("v")).otherwise(nothing).alias("v") if ignore else F.col("v"))

    return unwrapped(_reduce(b, _named(axis, axes), keepdims, kind, blocks, 1, "prod"), lazy)


def _extremum(name, pick, fold):
    def run(a: NDArray, axis=None, keepdims=False, nan_policy="propagate", axes=None, lazy=False):
        values.refuse(a.dtype, complex, name=name)
        ignore = _policy(nan_policy)

        def make(v):
            if a.dtype is not float:
                return fold(v) if a.dtype is bool else pick(v)
            best = pick(F.when(~F.isnan(v), v))
            return F.coalesce(best, F.lit(values.NAN)) if ignore else F.when(F.bool_or(F.isnan(v)), F.lit(values.NAN)).otherwise(best)

        return unwrapped(_reduce(a, _named(axis, axes), keepdims, a.dtype, make, None, name), lazy)

    run.__name__ = name
    return run


min = _extremum("min", F.min, F.bool_and)
max = _extremum("max", F.max, F.bool_or)


def mean(a: NDArray, axis=None, keepdims=False, nan_policy="propagate", axes=None, lazy=False):
    kind = complex if a.dtype is complex else float
    b, ignore = a.astype(kind), _policy(nan_policy)
    average = lambda v: F.struct(F.avg(v["re"]).alias("re"), F.avg(v["im"]).alias("im")) if kind is complex else F.avg(v)
    return unwrapped(_reduce(b, _named(axis, axes), keepdims, kind, lambda v: _skipping(average, v, kind, ignore), None, "mean"), lazy)


def _spread(name, total):
    def run(a: NDArray, axis=None, keepdims=False, nan_policy="propagate", axes=None, lazy=False):
        values.refuse(a.dtype, complex, name=name)
        ignore = _policy(nan_policy)
        return unwrapped(_reduce(a.astype(float), _named(axis, axes), keepdims, float, lambda v: _skipping(total, v, float, ignore), None, name), lazy)

    run.__name__ = name
    return run


var = _spread("var", F.var_pop)
std = _spread("std", F.stddev_pop)


def any(a: NDArray, axis=None, keepdims=False, lazy=False):
    return unwrapped(_reduce(a, axis, keepdims, bool, lambda v: F.bool_or(values.truth(v, a.dtype)), False, "any"), lazy)


def all(a: NDArray, axis=None, keepdims=False, lazy=False):
    return unwrapped(_reduce(a, axis, keepdims, bool, lambda v: F.bool_and(values.truth(v, a.dtype)), True, "all"), lazy)


def _arg(name, largest):
    def run(a: NDArray, axis: int | None = None, nan_policy="propagate", lazy=False):
        values.refuse(a.dtype, complex, name=name)
        ignore = _policy(nan_policy)
        place = linear(a.shape) if axis is None else F.col(f"i{geometry.normal_axis(axis, a.ndim)}")
        both = NDArray(a.base, F.struct(a.value.alias("v"), place.alias("at")), a.shape, a.dtype)

        def make(v):
            x, nan = v["v"], values.is_nan(v["v"], a.dtype)
            if largest:
                key = F.struct(nan.alias("nan"), x.alias("v"), (-v["at"]).alias("at"))
                return -(F.max(F.when(~nan, key)) if ignore else F.max(key))["at"]
            key = F.struct((~nan).alias("nan"), x.alias("v"), v["at"].alias("at"))
            return (F.min(F.when(~nan, key)) if ignore else F.min(key))["at"]

        found = _reduce(both, axis, False, int, make, None, name)
        if ignore and a.dtype is float and not found.df.filter("v IS NULL").limit(1).isEmpty():
            raise UnsupportedError(f"{name} of all-NaN slice")
        return unwrapped(found, lazy)

    run.__name__ = name
    return run


argmin = _arg("argmin", False)
argmax = _arg("argmax", True)


def _running(x, starts, sizes):
    """Running products, in place, of the runs of x with these starts and sizes: all short ones a place at a time, each
    long one by itself."""
    for start, size in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        np.multiply.accumulate(x[start : start + size], out=x[start : start + size])
    starts, sizes = starts[sizes <= SHORT_RUN], sizes[sizes <= SHORT_RUN]
    for k in range(1, sizes.max(initial=0)):
        starts, sizes = starts[sizes > k], sizes[sizes > k]
        x[starts + k] = x[starts + k - 1] * x[starts + k]


def _seen(flags, starts, sizes):
    """Whether a flag was set so far in its run."""
    so_far = np.cumsum(flags)
    return so_far > np.repeat(so_far[starts] - flags[starts], sizes)


def _multiplied(cells, keys, kind):
    """Running products of x within each group of keys, by at; from a null on they are null. Groups follow one another
    in a sorted partition, so that a batch is multiplied as a whole however small they are; the last one's goes on in the
    next batch."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns))
            group, x = np.stack([columns[k].to_numpy() for k in keys]), columns["x"]
            if kind is complex:
                done, lost = np.empty(len(x), complex), np.zeros(len(x), bool)
                done.real, done.imag = (x.field(c).to_numpy() for c in ("re", "im"))  # refuses nulls
            else:
                done, lost = x.fill_null(1).to_numpy().copy(), x.is_null().to_numpy(zero_copy_only=False).copy()
            ok = columns["ok"].to_numpy(zero_copy_only=False).copy()
            with np.errstate(all="ignore"):
                if last and (group[:, 0] == last[0]).all():
                    done[0], lost[0], ok[0] = last[1] * done[0], last[2] | lost[0], last[3] | ok[0]
                starts = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
                sizes = np.diff(starts, append=len(x))
                _running(done, starts, sizes)
            lost, ok = _seen(lost, starts, sizes), _seen(ok, starts, sizes)
            last = group[:, -1], done[-1], lost[-1], ok[-1]
            columns["x"] = pa.StructArray.from_arrays([done.real.copy(), done.imag.copy()], ["re", "im"]) if kind is complex else pa.array(done, mask=lost)
            columns["ok"] = pa.array(ok)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cells.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(run, cells.schema)


def _scan(cells, keys, n: int, kind, times: bool):
    """Running sums (or products) of the columns x and ok of cells (keys, at, x, ok, others) along at, for each group of
    keys, n cells each: the results of blocks, scanned in turn, are what the cells of later blocks start from."""
    own = [*keys, "block"]
    blocked = cells.withColumn("block", F.call_function("div", F.col("at"), F.lit(SCAN_BLOCK).cast("bigint")))
    w = Window.partitionBy(*own).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    part = (lambda x: F.struct(F.sum(x["re"]).over(w).alias("re"), F.sum(x["im"]).over(w).alias("im"))) if kind is complex else lambda x: F.sum(x).over(w)
    if times and kind is not float:
        inner = _multiplied(blocked, own, kind)
    else:
        inner = blocked.withColumn("x", F.product("x").over(w) if times else part(F.col("x"))).withColumn("ok", F.max("ok").over(w))
    if n <= SCAN_BLOCK:
        return inner.drop("block")
    last = inner.groupBy(*own).agg(F.max_by("x", "at").alias("x"), F.max("ok").alias("ok")).withColumnRenamed("block", "at")
    before = _scan(last, keys, -(-n // SCAN_BLOCK), kind, times).select(*keys, (F.col("at") + 1).alias("block"), F.col("x").alias("x0"), F.col("ok").alias("ok0"))
    joint = (values.multiply if times else values.add)(F.col("x0"), F.col("x"), kind)
    joined = inner.join(before, own, "left").withColumn("x", F.when(F.col("x0").isNull(), F.col("x")).otherwise(joint))
    return joined.withColumn("ok", F.col("ok") | F.coalesce("ok0", F.lit(False))).drop("block", "x0", "ok0")


def _cumulative(name: str, identity: int):
    @values.plan
    def run(a: NDArray, axis: int | None = None, nan_policy="propagate") -> NDArray:
        ignore, (b, kind) = _policy(nan_policy), _numbers(a)
        nan = values.is_nan(b.value, kind)
        x = (F.when(~nan, b.value).otherwise(values.constant(identity, kind)) if ignore else b.value).alias("x")
        nothing = values.constant(complex(values.NAN, values.NAN), complex) if kind is complex else F.lit(values.NAN)
        result = F.when(F.col("ok"), F.col("x")).otherwise(nothing) if ignore and kind in (float, complex) else F.col("x")
        if axis is None:
            cells = b.base.select(linear(b.shape).alias("at"), x, (~nan).alias("ok"))
            found = _scan(cells, [], b.size, kind, name == "cumprod")
            return NDArray.of(found.select(F.col("at").alias("i0"), result.alias("v")), (b.size,), kind)
        axis = geometry.normal_axis(axis, b.ndim)
        keys = [f"i{k}" for k in range(b.ndim) if k != axis]
        found = _scan(b.base.select(*keys, F.col(f"i{axis}").alias("at"), x, (~nan).alias("ok")), keys, b.shape[axis], kind, name == "cumprod")
        return NDArray.of(found.withColumnRenamed("at", f"i{axis}").select(*indices(b.ndim), result.alias("v")), b.shape, kind)

    run.__name__ = name
    run.__doc__ = "Along an axis, or flat in C order; integers wrap. Ignoring NaN, those before the first number stay and later ones repeat what there was."
    return run


cumsum = _cumulative("cumsum", 0)
cumprod = _cumulative("cumprod", 1)
