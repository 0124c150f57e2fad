"""Arrays that repeat others along axes, without a cell for each repetition.

Such an array has a source and, for each of its axes, the source's axis that it reads, or None where all cells are alike.
Views compose these maps; element-wise operations and most reductions work on the source. Cells are made, by a cross join
with the repeated indices, only for what has to see each of them.
"""

from __future__ import annotations

import functools
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.ndarray import NDArray


def repeated(source: NDArray, axes, shape, read_only: bool = False) -> NDArray:
    """An array of the shape whose axis k reads axis axes[k] of source, or repeats it; each axis of source, which has cells of
    its own, is read once."""
    from gridloom.operators.manipulation import reindexed

    if None in axes:
        return NDArray.repeating(source, axes, shape, read_only)
    found = source if list(axes) == list(range(source.ndim)) else reindexed(source, [F.col(f"i{s}") for s in axes], shape)
    return NDArray(*found.cells[:2], found.shape, found.dtype, found.cells[2], read_only)


def made(a: NDArray) -> tuple[DataFrame, object, bool]:
    """(base, value, free) with a row for each cell."""
    from gridloom.operators.ufunc import BROADCAST_CELLS
    from gridloom.sources.creation import grid

    source, axes = a.repeats
    repeats = [k for k, s in enumerate(axes) if s is None]
    own = source.base.select(*(F.col(f"i{s}").alias(f"i{k}") for k, s in enumerate(axes) if s is not None), source.value.alias("v"))
    shape = [a.shape[k] for k in repeats]
    others = grid(source.session, shape).select(*(F.col(f"i{j}").alias(f"i{k}") for j, k in enumerate(repeats)))
    if source.size <= BROADCAST_CELLS:
        cells = others.crossJoin(F.broadcast(own))
    else:
        cells = own.crossJoin(F.broadcast(others) if prod(shape) <= BROADCAST_CELLS else others)
    return cells, F.col("v"), True


def narrow(a: NDArray) -> NDArray:
    """a with its repeated axes of length 1: no cell comes twice."""
    from gridloom.operators.manipulation import reindexed

    if not a.repeats:
        return a
    source, axes = a.repeats
    return reindexed(source, [F.lit(0) if s is None else F.col(f"i{s}") for s in axes], [1 if s is None else n for s, n in zip(axes, a.shape)])


def stretched(a: NDArray, shape, read_only: bool = False) -> NDArray:
    """a broadcast to the shape, which it fits."""
    from gridloom.operators.manipulation import reindexed

    pad = len(shape) - a.ndim
    kept = [j for j in range(a.ndim) if a.shape[j] == shape[j + pad] and not (a.repeats and a.repeats[1][j] is None)]
    source = a.repeats[0] if a.repeats else a
    place = a.repeats[1] if a.repeats else range(a.ndim)
    # axes of length 1 that are stretched leave the source
    used = sorted(place[j] for j in kept)
    if len(used) < source.ndim:
        source = reindexed(source, [F.col(f"i{s}") for s in used], [source.shape[s] for s in used])
    axes = [None] * len(shape)
    for j in kept:
        axes[j + pad] = used.index(place[j])
    return repeated(source, axes, shape, read_only)


def elementwise(function):
    """Arrays that repeat are operands by their sources, and what the result repeats isn't made either."""

    @functools.wraps(function)
    def run(*operands, **options):
        arrays = [x for x in operands if isinstance(x, NDArray)]
        if not any(x.repeats for x in arrays):
            return function(*operands, **options)
        shape = geometry.broadcast(*(x.shape for x in arrays))
        found = function(*(narrow(x) if isinstance(x, NDArray) else x for x in operands), **options)
        return found if found.shape == shape else stretched(found, shape)

    return run


def _groups(old, new):
    """Axes of one shape and of another of as many cells that hold the same cells, in the shortest runs."""
    i = j = 0
    while i < len(old) or j < len(new):
        a, b, p, q = i, j, 1, 1
        while (i, j) == (a, b) or p != q:
            if (p <= q and i < len(old)) or j == len(new):
                p, i = p * old[i], i + 1
            else:
                q, j = q * new[j], j + 1
        yield range(a, i), range(b, j)


def reshaped(a: NDArray, shape) -> NDArray | None:
    """a under another shape, or None where that takes repeated and other axes together."""
    from gridloom.operators.manipulation import permute_axes, reshape

    source, axes = a.repeats
    kept, places = [], []
    for before, after in _groups(a.shape, shape):
        alike = {axes[k] is None for k in before}
        if len(alike) == 2:
            return None
        if alike == {False}:
            places += [len(kept) + k for k in range(len(after))]
            kept += [shape[k] for k in after]
        else:
            places += [None] * len(after)
    ordered = permute_axes(source, [s for s in axes if s is not None])
    return repeated(reshape(ordered, tuple(kept)), places, shape, a.read_only)


def permuted(a: NDArray, order) -> NDArray:
    source, axes = a.repeats
    return repeated(source, [axes[k] for k in order], [a.shape[k] for k in order], a.read_only)


def sliced(a: NDArray, entries) -> NDArray:
    """By integers, ranges and new axes, as resolved for a: ranges of repeated axes only change lengths."""
    from gridloom.operators import indexing

    source, axes = a.repeats
    key: list = [slice(None)] * source.ndim
    places, shape, gone = [], [], set()
    for axis, e in entries:
        if e is None:
            places.append(None)
            shape.append(1)
        elif isinstance(e, range):
            places.append(axes[axis])
            shape.append(len(e))
            if axes[axis] is not None:
                key[axes[axis]] = slice(e.start, e.stop if e.stop >= 0 else None, e.step)
        elif axes[axis] is not None:
            key[axes[axis]] = e
            gone.add(axes[axis])
    found = indexing.get(source, tuple(key), lazy=True)
    moved = {s: k for k, s in enumerate(s for s in range(source.ndim) if s not in gone)}
    return repeated(found, [None if s is None else moved[s] for s in places], shape, a.read_only)
