"""Indexing and assignment: integers and slices are filters and projections, index arrays and masks are joins."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.errors import ArrayIndexError, ShapeError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, linear, unwrapped
from gridloom.operators import repeats, selection, ufunc


def _expanded(key, ndim: int) -> list:
    """One entry for each axis or new axis: int, slice, None or array; a mask stands for its own number of axes."""
    entries = list(key) if isinstance(key, tuple) else [key]
    if sum(e is Ellipsis for e in entries) > 1:
        raise ArrayIndexError("an index can have a single ellipsis")
    used = sum(e.ndim if isinstance(e, NDArray) and e.dtype is bool else e is not None and e is not Ellipsis for e in entries)
    if used > ndim:
        raise ArrayIndexError("too many indices for array")
    if not any(e is Ellipsis for e in entries):
        entries.append(Ellipsis)
    at = next(k for k, e in enumerate(entries) if e is Ellipsis)
    return entries[:at] + [slice(None)] * (ndim - used) + entries[at + 1 :]


def _resolved(a: NDArray, key):
    """(entries with an axis each, arrays): masks become index arrays, integers and slices are checked."""
    result, axis = [], 0
    for e in _expanded(key, a.ndim):
        if e is None:
            result.append((None, None))
        elif isinstance(e, NDArray):
            if e.dtype is bool:
                if e.shape != a.shape[axis : axis + e.ndim]:
                    raise ArrayIndexError("boolean index shape does not match the axes that it indexes")
                for place in selection.nonzero(e):
                    result.append((axis, place))
                    axis += 1
                continue
            if e.dtype is not int:
                raise values.DTypeError("fancy index must be an integer or boolean array")
            n = a.shape[axis]
            ufunc._refuse_cells(e.base, (e.value < -n) | (e.value >= n), ArrayIndexError, f"index is out of bounds for axis {axis} with size {n}")
            result.append((axis, NDArray(e.base, F.when(e.value < 0, e.value + n).otherwise(e.value), e.shape, int)))
            axis += 1
        elif isinstance(e, slice):
            result.append((axis, range(*e.indices(a.shape[axis]))))
            axis += 1
        elif isinstance(e, int):
            if not -a.shape[axis] <= e < a.shape[axis]:
                raise ArrayIndexError(f"index {e} is out of bounds for axis {axis} with size {a.shape[axis]}")
            result.append((axis, e % a.shape[axis]))
            axis += 1
        else:
            raise values.DTypeError("index must be int, slice, ellipsis, None, or array")
    return result


def _in_range(column, r: range):
    if not len(r):
        return F.lit(False)
    low, high = sorted((r[0], r[-1]))
    return (column >= low) & (column <= high) & ((column - r[0]) % abs(r.step) == 0)


#: Picks of one place from which it is a hot one, and the parts that its picks are dealt out to.
HOT_PICKS, SALTS = 1 << 18, 64


def _gathered(cells, picks, keys, size: int, n: int, ndim: int):
    """The cells (size of them) that the n picks name. A small side is broadcast. Else places that are picked very often are found
    first: their cells are copied for each of SALTS parts of their picks, so that no task gets all picks of a place."""
    if size <= ufunc.BROADCAST_CELLS:
        return picks.join(F.broadcast(cells), keys)
    if n <= ufunc.BROADCAST_CELLS:
        return cells.join(F.broadcast(picks), keys)
    hot = picks.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_PICKS).select(*keys, F.lit(True).alias("hot"))
    hot = F.broadcast(hot) if n // HOT_PICKS <= ufunc.BROADCAST_CELLS else hot
    marked = picks.join(hot, keys, "left")
    part = F.pmod(F.xxhash64(*(f"f{k}" for k in range(ndim))), F.lit(SALTS))
    salted = marked.filter("hot").withColumn("part", part).drop("hot")
    copies = cells.join(hot, keys).drop("hot").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("part", F.col("part").cast("bigint"))
    return cells.join(marked.filter("hot IS NULL").drop("hot"), keys).unionByName(copies.join(salted, [*keys, "part"]).drop("part"))


def _target(a: NDArray, entries):
    """The cells that a resolved key selects: (rows with t0, t1, ... and, for each axis, s0, s1, ...; shape), t being places of the
    selection. Without index arrays the rows are those of a itself, with its cell."""
    arrays = [(axis, e) for axis, e in entries if isinstance(e, NDArray)]
    test = F.lit(True)
    for axis, e in entries:
        if isinstance(e, range):
            test = test & _in_range(F.col(f"i{axis}"), e)
        elif isinstance(e, int):
            test = test & (F.col(f"i{axis}") == e)
    cells = a.base.select(*indices(a.ndim), a.value.alias("v")).filter(test)
    places, shape, fancy_at, fancy_seen = [], [], None, []
    for k, (axis, e) in enumerate(entries):
        if e is None:
            places.append(F.lit(0).cast("bigint"))
            shape.append(1)
        elif isinstance(e, range):
            places.append(F.call_function("div", F.col(f"i{axis}") - F.lit(e.start), F.lit(e.step).cast("bigint")))
            shape.append(len(e))
        elif isinstance(e, NDArray):
            if fancy_at is None:
                fancy_at = len(places)
            fancy_seen.append(k)
    if arrays:
        # only index arrays count as neighbours: an integer between two of them keeps them apart
        together = fancy_seen == list(range(fancy_seen[0], fancy_seen[0] + len(fancy_seen)))
        fancy_at = fancy_at if together else 0
        joint = ufunc.aligned(*(e for _, e in arrays))
        picks = joint[0].base.select(*(F.col(i).alias(f"f{k}") for k, i in enumerate(indices(joint[0].ndim))), *(e.value.alias(f"i{axis}") for (axis, _), e in zip(arrays, joint)))
        size = prod([*(len(e) for _, e in entries if isinstance(e, range)), *(a.shape[axis] for axis, _ in arrays)])
        cells = _gathered(cells, picks, [f"i{axis}" for axis, _ in arrays], size, joint[0].size, joint[0].ndim)
        places[fancy_at:fancy_at] = [F.col(f"f{k}") for k in range(joint[0].ndim)]
        shape[fancy_at:fancy_at] = joint[0].shape
    return cells, places, tuple(shape)


@values.plan
def get(a: NDArray, key, lazy: bool = False):
    """The cells that key selects; a Python scalar, by a job, where integers select one, unless lazy asks for the array."""
    if isinstance(key, NDArray) and key.dtype is bool and key.shape == a.shape and a.ndim:
        return selection.masked(a, key)
    entries = _resolved(a, key)
    basic = not any(isinstance(e, NDArray) for _, e in entries)
    if a.repeats and basic and all(len(e) for _, e in entries if isinstance(e, range)):
        return unwrapped(repeats.sliced(a, entries), lazy)
    cells, places, shape = _target(a, entries)
    found = cells.select(*(p.cast("bigint").alias(f"i{k}") for k, p in enumerate(places)), "v")
    return unwrapped(NDArray(found, F.col("v"), shape, a.dtype, True, a.read_only and basic), lazy)


def _coerced(value, dtype):
    if dtype is bool and not isinstance(value, (bool, int)):
        raise values.DTypeError("cannot assign to a bool array")
    kind = values.kind_of(value)
    return values.cast(values.constant(value, kind), kind, dtype)


def _assigned_basic(a: NDArray, entries, value) -> NDArray:
    """By integers and slices: the cells' own indices say whether they are selected, and where in the selection."""
    test, places, shape = F.lit(True), [], []
    for axis, e in entries:
        if e is None:
            shape.append(1)
            places.append(F.lit(0).cast("bigint"))
        elif isinstance(e, range):
            test = test & _in_range(F.col(f"i{axis}"), e)
            shape.append(len(e))
            places.append(F.call_function("div", F.col(f"i{axis}") - F.lit(e.start), F.lit(e.step).cast("bigint")))
        else:
            test = test & (F.col(f"i{axis}") == e)
    shape = tuple(shape)
    if not isinstance(value, NDArray):
        return NDArray(a.base, F.when(test, _coerced(value, a.dtype)).otherwise(a.value), a.shape, a.dtype)
    if geometry.broadcast(value.shape, shape) != shape:
        raise ShapeError(f"cannot broadcast shape {value.shape} to {shape}")
    # an axis of length 1 is left out of the join's keys, and so are those that the value lacks
    pad = len(shape) - value.ndim
    value = repeats.narrow(value)
    keys = [(f"i{j}", j + pad) for j in range(value.ndim) if value.shape[j] == shape[j + pad] and shape[j + pad] != 1]
    source = value.astype(a.dtype)
    cells = 1
    for n in value.shape:
        cells *= n
    given = source.base.select(*(F.col(i).alias(f"t{k}") for i, k in keys), F.struct(source.value.alias("x")).alias("new"))
    if cells > ufunc.BROADCAST_CELLS:  # only the cells that are selected are joined
        whole = a.base.select(*indices(a.ndim), a.value.alias("v"))
        met = whole.filter(test).select(*indices(a.ndim), *(places[k].cast("bigint").alias(f"t{k}") for _, k in keys)).join(given, [f"t{k}" for _, k in keys])
        return NDArray.of(met.select(*indices(a.ndim), F.col("new.x").alias("v")).unionByName(whole.filter(~test)), a.shape, a.dtype)
    given = F.broadcast(given)
    own = a.base.select(*indices(a.ndim), a.value.alias("v"), test.alias("chosen"), *(F.when(test, places[k]).alias(f"t{k}") for _, k in keys))
    joined = own.join(given, [f"t{k}" for _, k in keys], "left") if keys else own.crossJoin(given)
    return NDArray.of(joined.select(*indices(a.ndim), F.when(F.col("chosen"), F.col("new.x")).otherwise(F.col("v")).alias("v")), a.shape, a.dtype)


@values.plan
def assigned(a: NDArray, key, value) -> NDArray:
    """a with the selected cells replaced: by a scalar, or by an array broadcast to the selection. Where index arrays name a
    cell more than once, the last in C order counts. Values take the array's dtype."""
    if isinstance(key, NDArray) and key.dtype is bool and key.shape == a.shape and a.ndim and not isinstance(value, NDArray):
        x, mask = ufunc.aligned(a, key)
        return NDArray(x.base, F.when(mask.value, _coerced(value, a.dtype)).otherwise(x.value), a.shape, a.dtype)
    entries = _resolved(a, key)
    if not any(isinstance(e, NDArray) for _, e in entries):
        return _assigned_basic(a, entries, value)
    cells, places, shape = _target(a, entries)
    chosen = cells.select(*indices(a.ndim), *(p.cast("bigint").alias(f"t{k}") for k, p in enumerate(places)))
    if isinstance(value, NDArray):
        if geometry.broadcast(value.shape, shape) != shape:
            raise ShapeError(f"cannot broadcast shape {value.shape} to {shape}")
        value, pad = repeats.narrow(value).astype(a.dtype), len(shape) - value.ndim
        named = {f"t{k + pad}": f"i{k}" for k, n in enumerate(value.shape) if n != 1}
        source = value.base.select(*(F.col(i).alias(t) for t, i in named.items()), value.value.alias("x"))
        source = F.broadcast(source) if value.size <= ufunc.BROADCAST_CELLS else source
        chosen = chosen.join(source, list(named)) if named else chosen.crossJoin(source)
    else:
        chosen = chosen.withColumn("x", _coerced(value, a.dtype))
    last = chosen.groupBy(*indices(a.ndim)).agg(F.max_by(F.struct("x"), linear(shape, [f"t{k}" for k in range(len(shape))])).alias("new"))
    merged = a.df.join(last, indices(a.ndim), "left") if a.ndim else a.df.crossJoin(last)
    return NDArray.of(merged.select(*indices(a.ndim), F.when(F.col("new").isNotNull(), F.col("new.x")).otherwise(F.col("v")).alias("v")), a.shape, a.dtype)
