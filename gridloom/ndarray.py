"""The array: one row a cell, keyed by explicit index columns, behind an immutable handle.

A handle is a base DataFrame, which has the index columns i0, i1, ... and any value columns, and an expression over it.
Arrays that share a base combine in one projection, without a join; others are joined on their indices. A handle is
free if its expression doesn't read the index columns: then a view of it keeps all value columns, and equal views of one
base share theirs. A handle may instead repeat another along axes; its base is then made when first asked for. Views of
broadcast arrays are read-only.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.errors import ReadOnlyError, ShapeError
from gridloom.functions import values


def indices(ndim: int) -> list[str]:
    return [f"i{k}" for k in range(ndim)]


def linear(shape, names=None) -> Column:
    """The C-order place of a cell."""
    total = F.lit(0).cast("bigint")
    for name, step in zip(names or indices(len(shape)), geometry.strides(shape)):
        total = total + F.col(name) * F.lit(step)
    return total


def unravelled(lin: Column, shape) -> list[Column]:
    """The index columns of a C-order place; whole division, so that large places stay exact."""
    return [F.call_function("div", lin, F.lit(step).cast("bigint")) % F.lit(max(n, 1)).cast("bigint") for n, step in zip(shape, geometry.strides(shape))]


def unwrapped(a: NDArray, lazy: bool = False):
    """A Python scalar for an array without axes, by a job; the array itself if it has axes or lazy asks for it."""
    return a if lazy or a.ndim else a.item()


class NDArray:
    def __init__(self, base: DataFrame, value: Column, shape, dtype, free: bool = False, read_only: bool = False):
        self._cells, self.repeats = (base, value, free), None
        self.shape, self.dtype, self.read_only = tuple(shape), values.checked(dtype), read_only

    @classmethod
    def repeating(cls, source: NDArray, axes, shape, read_only: bool) -> NDArray:
        a = cls(None, None, shape, source.dtype, read_only=read_only)
        a._cells, a.repeats = None, (source, tuple(axes))
        return a

    @property
    def cells(self) -> tuple[DataFrame, Column, bool]:
        if self._cells is None:
            from gridloom.operators import repeats

            self._cells = repeats.made(self)
        return self._cells

    base = property(lambda self: self.cells[0])
    value = property(lambda self: self.cells[1])
    free = property(lambda self: self.cells[2])

    @property
    def session(self):
        return self.repeats[0].session if self.repeats else self.base.sparkSession

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("len() of unsized object")
        return self.shape[0]

    @property
    @values.plan
    def df(self) -> DataFrame:
        """Columns i0, i1, ... and v."""
        return self.base.select(*indices(self.ndim), self.value.alias("v"))

    @values.plan
    def to_dataframe(self) -> DataFrame:
        """As df; complex cells have the columns re and im instead of v."""
        if self.dtype is complex:
            return self.df.select(*indices(self.ndim), F.col("v.re").alias("re"), F.col("v.im").alias("im"))
        return self.df

    @classmethod
    def of(cls, df: DataFrame, shape, dtype) -> NDArray:
        return cls(df, F.col("v"), shape, dtype, free=True)

    def astype(self, dtype) -> NDArray:
        if self.repeats:
            return NDArray.repeating(self.repeats[0].astype(dtype), self.repeats[1], self.shape, False)
        return NDArray(self.base, values.cast(self.value, self.dtype, values.checked(dtype)), self.shape, dtype, self.free)

    def copy(self) -> NDArray:
        """Another handle, which may be assigned to."""
        return NDArray.repeating(*self.repeats, self.shape, False) if self.repeats else NDArray(*self.cells[:2], self.shape, self.dtype, self.free)

    def view(self) -> NDArray:
        """The same cells under another handle. Assignment changes a handle, never cells, so that views and copies differ only in
        that a view of a read-only array is read-only."""
        a = self.copy()
        a.read_only = self.read_only
        return a

    @property
    def flat(self):
        from gridloom.operators import iteration

        return iteration.flat(self)

    def __iter__(self):
        """Sub-arrays of the first axis; the scalars of a vector, streamed."""
        if not self.ndim:
            raise TypeError("iteration over an array without axes")
        return self.flat if self.ndim == 1 else (self[k] for k in range(self.shape[0]))

    def __repr__(self) -> str:
        from gridloom.operators import text

        return text.described(self)

    def __str__(self) -> str:
        from gridloom.operators import text

        return text.printed(self)

    def to_list(self):
        """Nested Python lists in C order: every cell comes to the driver."""
        cells = [r["v"] for r in (self.df.orderBy(*indices(self.ndim)) if self.ndim else self.df).collect()]
        if self.dtype is complex:
            cells = [complex(c["re"], c["im"]) for c in cells]
        for n in reversed(self.shape[1:]):
            cells = [cells[k * n : (k + 1) * n] for k in range(len(cells) // n if n else 0)]
        return cells if self.shape else cells[0]

    def item(self):
        if self.size != 1:
            raise ShapeError("only arrays of one cell are scalars")
        if self.repeats:
            return self.repeats[0].item()
        cell = self.df.first()["v"]
        return complex(cell["re"], cell["im"]) if self.dtype is complex else cell

    # Operators; the functions live in gridloom.operators.
    def _binary(self, name, other, swapped=False):
        from gridloom.operators import ufunc

        return getattr(ufunc, name)(other, self) if swapped else getattr(ufunc, name)(self, other)

    __hash__ = None

    def __neg__(self):
        from gridloom.operators import ufunc

        return ufunc.negative(self)

    def __abs__(self):
        from gridloom.operators import ufunc

        return ufunc.absolute(self)

    def __matmul__(self, other):
        from gridloom.operators import linalg

        return linalg.matmul(self, other)

    def __getitem__(self, key):
        from gridloom.operators import indexing

        return indexing.get(self, key)

    def __setitem__(self, key, value):
        from gridloom.operators import indexing

        if self.read_only:
            raise ReadOnlyError("array is read-only")
        self._cells, self.repeats = indexing.assigned(self, key, value).cells, None

    def reshape(self, *shape):
        from gridloom.operators import manipulation

        return manipulation.reshape(self, shape[0] if len(shape) == 1 else shape)

    def transpose(self):
        return self.permute_axes(tuple(reversed(range(self.ndim))))

    T = property(transpose)

    def permute_axes(self, axes):
        from gridloom.operators import manipulation

        return manipulation.permute_axes(self, axes)

    def squeeze(self, axis=None):
        from gridloom.operators import manipulation

        return manipulation.squeeze(self, axis)


def _operators() -> None:
    pairs = {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "trunc_divide", "mod": "remainder", "pow": "power"}
    for short, name in pairs.items():
        setattr(NDArray, f"__{short}__", lambda a, b, name=name: a._binary(name, b))
        setattr(NDArray, f"__r{short}__", lambda a, b, name=name: a._binary(name, b, True))
    for short, name in {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}.items():
        setattr(NDArray, f"__{short}__", lambda a, b, name=name: a._binary(name, b))


_operators()


def _power(a, b, modulus=None):
    if modulus is not None:
        raise TypeError("modular array power is not supported")
    return a._binary("power", b)


NDArray.__pow__ = _power
