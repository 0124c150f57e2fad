"""Views and restructuring: projections of the index columns, and unions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.errors import ShapeError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, linear, unravelled, unwrapped
from gridloom.operators import repeats


@values.plan
def reindexed(a: NDArray, columns, shape) -> NDArray:
    """The cells of a under new index columns."""
    if a.free:
        views = a.base.__dict__.setdefault("_views", {})
        key = tuple(map(str, columns))
        if key not in views:
            kept = [c for c in a.base.columns if not re.fullmatch(r"i\d+", c)]
            views[key] = a.base.select(*(c.cast("bigint").alias(i) for c, i in zip(columns, indices(len(columns)))), *kept)
        return NDArray(views[key], a.value, shape, a.dtype, True, a.read_only)
    cells = a.base.select(*(c.cast("bigint").alias(i) for c, i in zip(columns, indices(len(columns)))), a.value.alias("v"))
    return NDArray(cells, F.col("v"), shape, a.dtype, True, a.read_only)


def reshape(a: NDArray, shape) -> NDArray:
    """Of an array that repeats, repeated axes stay so unless the new ones take them together with others; that makes cells,
    as a copy."""
    shape = geometry.reshaped(a.shape, shape)
    if a.repeats:
        found = repeats.reshaped(a, shape)
        return reshape(NDArray(*a.cells[:2], a.shape, a.dtype, True), shape) if found is None else found
    return reindexed(a, unravelled(linear(a.shape), shape), shape)


def permute_axes(a: NDArray, axes) -> NDArray:
    axes = [geometry.normal_axis(x, a.ndim) for x in axes]
    if sorted(axes) != list(range(a.ndim)):
        raise ShapeError("axes must be a permutation")
    if a.repeats:
        return repeats.permuted(a, axes)
    return reindexed(a, [F.col(f"i{x}") for x in axes], [a.shape[x] for x in axes])


def squeeze(a: NDArray, axis=None, lazy: bool = False):
    axes = tuple(k for k, n in enumerate(a.shape) if n == 1) if axis is None else geometry.normal_axes(axis, a.ndim)
    if any(a.shape[k] != 1 for k in axes):
        raise ShapeError("".join(f"cannot squeeze axis {k} with length {a.shape[k]}" for k in [next(k for k in axes if a.shape[k] != 1)]))
    kept = [k for k in range(a.ndim) if k not in axes]
    if a.repeats:
        return unwrapped(repeats.sliced(a, [(k, range(n) if k in kept else 0) for k, n in enumerate(a.shape)]), lazy)
    return unwrapped(reindexed(a, [F.col(f"i{k}") for k in kept], [a.shape[k] for k in kept]), lazy)


@values.plan
def broadcast_to(a: NDArray, shape) -> NDArray:
    """A read-only view that repeats a, without cells of its own."""
    shape = geometry.checked_shape(shape)
    if geometry.broadcast(a.shape, shape) != shape:
        raise ShapeError(f"cannot broadcast shape {a.shape} to {shape}")
    if 0 in shape:
        from gridloom.sources.creation import full

        found = full(a.session, shape, 0, a.dtype)
        found.read_only = True
        return found
    return repeats.stretched(a, shape, True)


def broadcast_shapes(*shapes) -> tuple[int, ...]:
    """The common shape of shapes whose trailing axes agree or are 1; () of none."""
    return geometry.broadcast(*map(geometry.checked_shape, shapes))


def broadcast_arrays(arrays) -> list[NDArray]:
    """Read-only views of the arrays, all of their common shape."""
    arrays = _sequence(arrays, "broadcast_arrays")
    shape = geometry.broadcast(*(a.shape for a in arrays))
    return [broadcast_to(a, shape) for a in arrays]


def _sequence(arrays, name: str) -> list[NDArray]:
    if not isinstance(arrays, (list, tuple)) or not all(isinstance(a, NDArray) for a in arrays):
        raise values.DTypeError(f"{name} argument must be a sequence of arrays")
    return list(arrays)


@values.plan
def concatenate(arrays, axis=0) -> NDArray:
    arrays = _sequence(arrays, "concatenate")
    if not arrays:
        raise ShapeError("concatenate requires at least one array")
    first = arrays[0]
    axis = geometry.normal_axis(axis, first.ndim)
    if any(a.dtype is not first.dtype for a in arrays):
        raise values.DTypeError("all arrays must have the same dtype in concatenate")
    if any(a.ndim != first.ndim or a.shape[:axis] + a.shape[axis + 1 :] != first.shape[:axis] + first.shape[axis + 1 :] for a in arrays):
        raise ShapeError("all dimensions but the concatenation axis must match")
    parts, offset = [], 0
    for a in arrays:
        parts.append(a.df.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(offset).cast("bigint")))
        offset += a.shape[axis]
    return NDArray.of(reduce(lambda x, y: x.unionByName(y), parts), first.shape[:axis] + (offset,) + first.shape[axis + 1 :], first.dtype)


def stack(arrays, axis=0) -> NDArray:
    arrays = _sequence(arrays, "stack")
    if not arrays or any(a.shape != arrays[0].shape for a in arrays):
        raise ShapeError("all arrays must have the same shape")
    axis = geometry.normal_axis(axis, arrays[0].ndim + 1)
    return concatenate([reshape(a, a.shape[:axis] + (1,) + a.shape[axis:]) for a in arrays], axis)


def vstack(arrays) -> NDArray:
    return concatenate([reshape(a, (1, a.size)) if a.ndim == 1 else a for a in _sequence(arrays, "vstack")], 0)


def hstack(arrays) -> NDArray:
    arrays = _sequence(arrays, "hstack")
    return concatenate(arrays, 0 if arrays and arrays[0].ndim == 1 else 1)
