"""Cells in C order, streamed to the driver a partition at a time."""

from __future__ import annotations

import itertools
import math

from gridloom import geometry
from gridloom.errors import ShapeError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices
from gridloom.operators import ufunc


def _cell(v):
    return complex(v["re"], v["im"]) if hasattr(v, "asDict") else v


class ndindex:
    """All index tuples of a shape in C order; its length is their number."""

    def __init__(self, shape):
        self.shape = geometry.checked_shape(shape)

    def __len__(self) -> int:
        return math.prod(self.shape)

    def __iter__(self):
        return itertools.product(*map(range, self.shape))


def ndenumerate(a: NDArray):
    for row in a.df.orderBy(*indices(a.ndim)).toLocalIterator():
        yield tuple(row[: a.ndim]), _cell(row["v"])


def flat(a: NDArray):
    return (v for _, v in ndenumerate(a))


def nditer(arrays: tuple):
    """The cells of one array, or pairs of cells of two of one dtype, broadcast together. What can't be iterated over is
    refused at once."""
    if not isinstance(arrays, tuple) or not all(isinstance(a, NDArray) for a in arrays):
        raise values.DTypeError("each operand of nditer must be an array")
    if len(arrays) not in (1, 2):
        raise ShapeError("nditer supports 1-2 operands")
    if len(arrays) == 1:
        return flat(arrays[0])
    return ((_cell(row["a"]), _cell(row["b"])) for row in _both(*arrays).toLocalIterator())


@values.plan
def _both(x: NDArray, y: NDArray):
    if x.dtype is not y.dtype:
        raise ShapeError("nditer requires operands with the same dtype")
    x, y = ufunc.aligned(x, y)
    return x.base.select(*indices(x.ndim), x.value.alias("a"), y.value.alias("b")).orderBy(*indices(x.ndim))
