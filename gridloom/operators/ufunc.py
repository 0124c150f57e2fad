"""Element-wise operations, broadcasting as joins on the shared indices."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.errors import DivideByZeroError, UnsupportedError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices
from gridloom.operators.repeats import elementwise

#: Cells of a side that is broadcast at most: 16 bytes an index or value, so about 100 MB.
BROADCAST_CELLS = 1_000_000


@values.plan
def aligned(*operands: NDArray) -> list[NDArray]:
    """The operands over one base, of the common shape. Those that share a base and a shape are only projected; an axis of
    length 1 against a longer one is left out of the join's keys; a small side is broadcast, its size being known."""
    shape = geometry.broadcast(*(a.shape for a in operands))
    first = operands[0]
    if all(a.base is first.base and a.shape == shape for a in operands):
        return list(operands)
    named = indices(len(shape))
    sides, bases = [], []
    for k, a in enumerate(operands):
        found = next((s for s in sides if s[0] is a.base and s[1] == a.shape), None)
        if found is None:
            sides.append((a.base, a.shape, []))
            found = sides[-1]
        found[2].append((k, a))
    for base, own, members in sides:
        pad = len(shape) - len(own)
        keys = [(f"i{j}", named[j + pad]) for j, n in enumerate(own) if n == shape[j + pad] and (n != 1 or shape[j + pad] == 1)]
        bases.append((base.select(*(F.col(o).alias(n) for o, n in keys), *(a.value.alias(f"o{k}") for k, a in members)), {n for _, n in keys}, own))
    bases.sort(key=lambda b: -len(b[1]))
    joined, have, _ = bases[0]
    for df, keys, own in bases[1:]:
        shared = sorted(have & keys)
        cells = 1
        for n in own:
            cells *= n
        df = F.broadcast(df) if cells <= BROADCAST_CELLS else df
        joined = joined.join(df, shared) if shared else joined.crossJoin(df)
        have = have | keys
    return [NDArray(joined, F.col(f"o{k}"), shape, a.dtype, free=True) for k, a in enumerate(operands)]


def accepting(function):
    """Nested sequences become arrays, and scalars alone give a scalar, by a job."""
    function = elementwise(function)

    @functools.wraps(function)
    def run(*operands, **options):
        from gridloom.sources.creation import array

        if any(isinstance(x, NDArray) for x in operands) and not any(isinstance(x, (list, tuple)) for x in operands):
            return function(*operands, **options)
        spark = next((x.session for x in operands if isinstance(x, NDArray)), None) or SparkSession.builder.getOrCreate()
        if any(isinstance(x, (NDArray, list, tuple)) for x in operands):
            return function(*(array(spark, x) if isinstance(x, (list, tuple)) else x for x in operands), **options)
        return function(*(array(spark, [x]) for x in operands), **options).to_list()[0]

    return run


def lifted(a, b):
    """Both as arrays over one base, or one as a constant; and the promoted dtype."""
    if not isinstance(a, NDArray):
        kind = values.promote(values.kind_of(a), b.dtype)
        return NDArray(b.base, values.constant(a, kind), b.shape, kind, free=True), b, kind
    if not isinstance(b, NDArray):
        kind = values.promote(values.kind_of(b), a.dtype)
        return a, NDArray(a.base, values.constant(b, kind), a.shape, kind, free=True), kind
    x, y = aligned(a, b)
    return x, y, values.promote(a.dtype, b.dtype)


@values.plan
def _refuse_cells(base, bad, error, message):
    if not base.filter(bad).select(F.lit(1)).limit(1).isEmpty():
        raise error(message)


def _arithmetic(name):
    @accepting
    @values.plan
    def run(a, b, lazy: bool = False) -> NDArray:
        x, y, kind = lifted(a, b)
        if kind is bool:
            raise UnsupportedError(f"{name} is not supported for bool and bool")
        u, v = values.cast(x.value, x.dtype, kind), values.cast(y.value, y.dtype, kind)
        if kind is int and not lazy:
            least = F.lit(-(1 << 63)).cast("bigint")
            if name in ("divide", "trunc_divide", "remainder"):
                _refuse_cells(x.base, v == 0, DivideByZeroError, "integer division by zero")
                _refuse_cells(x.base, (u == least) & (v == -1), UnsupportedError, "integer overflow in division")
            if name == "power":
                _refuse_cells(x.base, (v < 0) | (v > (1 << 32) - 1), UnsupportedError, "integer exponent out of range")
        return NDArray(x.base, values.ARITHMETIC[name](u, v, kind), x.shape, kind, x.free and y.free)

    run.__name__ = name
    run.__doc__ = f"{name} of two arrays, or of an array and a scalar. Integer cells without a result are refused by a job before the plan is returned; lazy leaves that out."
    return run


add, subtract, multiply, divide, trunc_divide, remainder, power = map(_arithmetic, values.ARITHMETIC)


def _comparison(name):
    @accepting
    @values.plan
    def run(a, b) -> NDArray:
        x, y, kind = lifted(a, b)
        if name not in ("equal", "not_equal") and kind in (bool, complex):
            raise UnsupportedError(f"ordering comparisons not supported for {'complex' if kind is complex else 'bool'}")
        return NDArray(x.base, values.COMPARE[name](values.cast(x.value, x.dtype, kind), values.cast(y.value, y.dtype, kind), kind), x.shape, bool, x.free and y.free)

    run.__name__ = name
    return run


equal, not_equal, less, less_equal, greater, greater_equal = map(_comparison, values.COMPARE)


@accepting
def logical_and(a, b) -> NDArray:
    x, y, _ = lifted(a, b)
    return NDArray(x.base, values.truth(x.value, x.dtype) & values.truth(y.value, y.dtype), x.shape, bool, x.free and y.free)


@accepting
def logical_or(a, b) -> NDArray:
    x, y, _ = lifted(a, b)
    return NDArray(x.base, values.truth(x.value, x.dtype) | values.truth(y.value, y.dtype), x.shape, bool, x.free and y.free)


@accepting
def logical_not(a: NDArray) -> NDArray:
    return NDArray(a.base, ~values.truth(a.value, a.dtype), a.shape, bool, a.free)


@accepting
def negative(a: NDArray) -> NDArray:
    return NDArray(a.base, values.negative(a.value, a.dtype), a.shape, a.dtype, a.free)


@accepting
def absolute(a: NDArray) -> NDArray:
    return NDArray(a.base, values.absolute(a.value, a.dtype), a.shape, float if a.dtype is complex else a.dtype, a.free)


def _test(name, real):
    @accepting
    def run(a: NDArray) -> NDArray:
        values.refuse(a.dtype, bool, int, name=name)
        if a.dtype is float:
            return NDArray(a.base, real(a.value), a.shape, bool)
        re, im = real(a.value["re"]), real(a.value["im"])
        return NDArray(a.base, re & im if name == "isfinite" else re | im, a.shape, bool)

    run.__name__ = name
    return run


isnan = _test("isnan", F.isnan)
isinf = _test("isinf", lambda v: F.abs(v) == values.INF)
isfinite = _test("isfinite", lambda v: ~F.isnan(v) & (F.abs(v) < values.INF))


def _part(name, pick, kind):
    @accepting
    def run(a: NDArray) -> NDArray:
        values.refuse(a.dtype, bool, int, float, name=name)
        return NDArray(a.base, pick(a.value), a.shape, kind)

    run.__name__ = name
    return run


conj = _part("conj", lambda v: F.struct(v["re"].alias("re"), (-v["im"]).alias("im")), complex)
real = _part("real", lambda v: v["re"], float)
imag = _part("imag", lambda v: v["im"], float)


@elementwise
def complex_of(re: NDArray, im: NDArray) -> NDArray:
    """re + im j of two real arrays."""
    x, y = aligned(re, im)
    return NDArray(x.base, F.struct(values.cast(x.value, x.dtype, float).alias("re"), values.cast(y.value, y.dtype, float).alias("im")), x.shape, complex, x.free and y.free)
