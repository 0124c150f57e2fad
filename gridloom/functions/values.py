"""Values of the four kinds as Spark columns: types, promotion, casts, IEEE comparison and division, wrapping integers."""

from __future__ import annotations

import functools
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import DTypeError, UnsupportedError

#: In the order of promotion.
ORDER = (bool, int, float, complex)
NAMES = {bool: "bool", int: "int64", float: "float64", complex: "complex128"}
SPARK = {bool: "boolean", int: "bigint", float: "double", complex: "struct<re:double,im:double>"}
NAN, INF = float("nan"), float("inf")


@contextmanager
def wrapping(spark: SparkSession):
    """Plans built inside wrap integers and give null for what they can't cast; the session's own setting comes back."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def plan(function):
    """Runs a function that builds plans under wrapping()."""

    @functools.wraps(function)
    def run(*args, **options):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        with wrapping(spark):
            return function(*args, **options)

    return run


def checked(dtype) -> type:
    if dtype not in ORDER:
        raise DTypeError(f"unsupported dtype: {dtype!r}")
    return dtype


def promote(*dtypes) -> type:
    return max(dtypes, key=ORDER.index)


def kind_of(value) -> type:
    for kind in ORDER:
        if isinstance(value, kind):
            return kind
    raise DTypeError(f"unsupported element type: {type(value).__name__}")


def constant(value, dtype) -> Column:
    if dtype is complex:
        value = complex(value)
        return F.struct(F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
    return F.lit(dtype(value)).cast(SPARK[dtype])


def cast(v: Column, old, new) -> Column:
    """Floats become integers by truncation, held at the limits, NaN as 0; complex numbers lose the imaginary part."""
    if old is new:
        return v
    if old is complex:
        return truth(v, complex) if new is bool else cast(v["re"], float, new)
    if new is complex:
        return F.struct(cast(v, old, float).alias("re"), F.lit(0.0).alias("im"))
    if new is bool:
        return truth(v, old)
    return v.cast("int").cast(SPARK[new]) if old is bool else v.cast(SPARK[new])


def truth(v: Column, dtype) -> Column:
    if dtype is bool:
        return v
    if dtype is complex:
        return (v["re"] != 0) | (v["im"] != 0)
    return v != 0


def is_nan(v: Column, dtype) -> Column:
    if dtype is float:
        return F.isnan(v)
    if dtype is complex:
        return F.isnan(v["re"]) | F.isnan(v["im"])
    return F.lit(False)


def _ordered(a: Column, b: Column, test: Column, dtype) -> Column:
    return test if dtype is int else test & ~F.isnan(a) & ~F.isnan(b)


def equal(a, b, dtype):
    if dtype is complex:
        return equal(a["re"], b["re"], float) & equal(a["im"], b["im"], float)
    return (a == b) & ~F.isnan(a) if dtype is float else a == b


COMPARE = {
    "equal": equal, "not_equal": lambda a, b, d: ~equal(a, b, d), "less": lambda a, b, d: _ordered(a, b, a < b, d), "less_equal": lambda a, b, d: _ordered(a, b, a <= b, d),
    "greater": lambda a, b, d: _ordered(a, b, a > b, d), "greater_equal": lambda a, b, d: _ordered(a, b, a >= b, d),
}


def _struct(re, im):
    return F.struct(re.alias("re"), im.alias("im"))


def add(a, b, dtype):
    return _struct(a["re"] + b["re"], a["im"] + b["im"]) if dtype is complex else a + b


def subtract(a, b, dtype):
    return _struct(a["re"] - b["re"], a["im"] - b["im"]) if dtype is complex else a - b


def multiply(a, b, dtype):
    return _struct(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"]) if dtype is complex else a * b


def float_divide(a, b):
    """IEEE division: Spark's own gives null for a zero divisor, its power an infinity of the zero's sign."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def divide(a, b, dtype):
    """Integers are divided exactly and toward zero; a zero divisor gives null, for the caller to have refused."""
    if dtype is int:
        return F.call_function("div", a, b)
    if dtype is complex:
        norm = b["re"] * b["re"] + b["im"] * b["im"]
        return _struct(float_divide(a["re"] * b["re"] + a["im"] * b["im"], norm), float_divide(a["im"] * b["re"] - a["re"] * b["im"], norm))
    return float_divide(a, b)


def truncated(q):
    return F.when(F.isnan(q) | (F.abs(q) >= 2.0**52), q).when(q < 0, -F.floor(-q).cast("double")).otherwise(F.floor(q).cast("double"))


def trunc_divide(a, b, dtype):
    if dtype is int:
        return divide(a, b, int)
    if dtype is complex:
        q = divide(a, b, complex)
        return _struct(truncated(q["re"]), truncated(q["im"]))
    return truncated(float_divide(a, b))


def remainder(a, b, dtype):
    if dtype is complex:
        return subtract(a, multiply(trunc_divide(a, b, complex), b, complex), complex)
    return F.when(b == 0, F.lit(NAN)).otherwise(a % b) if dtype is float else a % b


def power(a, b, dtype):
    if dtype is int:
        step = F.struct(F.lit(1).cast("bigint").alias("a"), a.alias("s"), b.alias("e"))
        double = lambda x, _: F.struct(F.when(x["e"] % 2 == 1, x["a"] * x["s"]).otherwise(x["a"]).alias("a"), (x["s"] * x["s"]).alias("s"), F.shiftright(x["e"], 1).alias("e"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), step, double, lambda x: x["a"])
    if dtype is complex:
        size, angle = F.hypot(a["re"], a["im"]), F.atan2(a["im"], a["re"])
        r = F.pow(size, b["re"]) * F.exp(-b["im"] * angle)
        turn = b["im"] * F.log(size) + b["re"] * angle
        return F.when((b["re"] == 0) & (b["im"] == 0), constant(1, complex)).when(size == 0, constant(0, complex)).otherwise(_struct(r * F.cos(turn), r * F.sin(turn)))
    return F.when(a == 1, F.lit(1.0)).when((a == -1) & (F.abs(b) == INF), F.lit(1.0)).otherwise(F.pow(a, b))


ARITHMETIC = {"add": add, "subtract": subtract, "multiply": multiply, "divide": divide, "trunc_divide": trunc_divide, "remainder": remainder, "power": power}


def absolute(v, dtype):
    return F.hypot(v["re"], v["im"]) if dtype is complex else v if dtype is bool else F.abs(v)


def negative(v, dtype):
    return _struct(-v["re"], -v["im"]) if dtype is complex else v if dtype is bool else -v


def refuse(dtype, *kinds, name: str) -> None:
    if dtype in kinds:
        raise UnsupportedError(f"{name} is not supported for dtype {NAMES[dtype]}")
