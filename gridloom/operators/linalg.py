"""Products and diagonals of matrices."""

from __future__ import annotations

from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom import geometry
from gridloom.errors import ShapeError
from gridloom.functions import values
from gridloom.ndarray import NDArray, indices, unwrapped
from gridloom.operators import manipulation, reduction, repeats


def _contracted(kind, x, y):
    product = values.multiply(x, y, kind)
    return F.struct(F.sum(product["re"]).alias("re"), F.sum(product["im"]).alias("im")) if kind is complex else F.sum(product)


#: Products of cells that a join's rows may stand for one by one; more are multiplied by tiles of this side. Cells of a matrix that
#: each task may hold (a result that is summed up, or a small factor), and cells of a panel of rows.
JOINED_PRODUCTS, TILE = 50_000_000, 256
HELD_CELLS, PANEL_CELLS = 1 << 18, 1 << 20
NUMPY = {int: np.int64, float: np.float64, complex: np.complex128}


def _dense(group: pd.DataFrame, row: str, column: str, value: str, kind, side: int) -> np.ndarray:
    x = np.zeros((side, side), {int: np.int64, float: np.float64, complex: np.complex128}[kind])
    cells = np.array([complex(c["re"], c["im"]) for c in group[value]]) if kind is complex else group[value].to_numpy()
    x[group[row].to_numpy() % side, group[column].to_numpy() % side] = cells
    return x


def _tiled(x, y, names, kind, shape):
    """names, r, c and v of the product of x (names, r, k, x) and y (names, k, c, y): cells are put together as tiles, pairs of
    tiles that share a stretch of k are multiplied, and their products added up. An integer tile wraps as its cells do."""
    side = TILE
    tile = lambda name: F.call_function("div", F.col(name), F.lit(side).cast("bigint"))
    keys = ", ".join(f"{n} bigint" for n in names) + (", " if names else "")
    numpy_kind = {int: "<i8", float: "<f8", complex: "<c16"}[kind]

    def gathered(df, row, column, value):
        def run(key, group):
            return pd.DataFrame([(*key, _dense(group, row, column, value, kind, side).tobytes())], columns=[*names, f"t{row}", f"t{column}", f"tile_{value}"])

        dealt = df.withColumn(f"t{row}", tile(row)).withColumn(f"t{column}", tile(column))
        return dealt.groupBy(*names, f"t{row}", f"t{column}").applyInPandas(run, f"{keys}t{row} bigint, t{column} bigint, tile_{value} binary")

    def multiplied(batches):
        for batch in batches:
            done = [(np.frombuffer(a, numpy_kind).reshape(side, side) @ np.frombuffer(b, numpy_kind).reshape(side, side)).tobytes() for a, b in zip(batch["tile_x"], batch["tile_y"])]
            yield batch[[*names, "tr", "tc", "tk"]].assign(tile=done)

    def added(key, group):
        total = np.sum([np.frombuffer(t, numpy_kind) for t in group["tile"]], axis=0).reshape(side, side)
        r, c = int(key[-2]) * side, int(key[-1]) * side
        total = total[: shape[0] - r, : shape[1] - c]
        rows, columns = np.indices(total.shape)
        flat = total.ravel()
        v = [{"re": z.real, "im": z.imag} for z in flat.tolist()] if kind is complex else flat
        return pd.DataFrame({**dict(zip(names, key)), "r": rows.ravel() + r, "c": columns.ravel() + c, "v": v})

    pairs = gathered(x, "r", "k", "x").join(gathered(y, "k", "c", "y"), [*names, "tk"])
    products = pairs.mapInPandas(multiplied, f"{keys}tr bigint, tc bigint, tk bigint, tile binary")
    # sums of a few tiles at a time, then of those, so that no task holds all that one tile of the result is made of; dealt by
    # what the tiles are, so that a task that runs again deals alike
    few = products.withColumn("few", F.pmod(F.xxhash64(*names, "tr", "tc", "tk"), F.lit(64))).drop("tk")

    def partly(key, group):
        return pd.DataFrame([(*key[:-1], np.sum([np.frombuffer(t, numpy_kind) for t in group["tile"]], axis=0).tobytes())], columns=[*names, "tr", "tc", "tile"])

    some = few.groupBy(*names, "tr", "tc", "few").applyInPandas(partly, f"{keys}tr bigint, tc bigint, tile binary")
    return some.groupBy(*names, "tr", "tc").applyInPandas(added, f"{keys}r bigint, c bigint, v {values.SPARK[kind]}")


def _panels(batches, sides, lines: int, kind):
    """(first line, a matrix for each of sides, which are their widths) of cells (panel, line, side, at, re, im) that come sorted by
    panel: lines in a panel, `at` along the width."""
    held, matrices = None, None
    for batch in batches:
        panel = batch["panel"].to_numpy()
        cuts = [0, *(np.flatnonzero(panel[1:] != panel[:-1]) + 1).tolist(), len(panel)] if len(panel) else []
        for start, end in zip(cuts, cuts[1:]):
            if panel[start] != held:
                if matrices is not None:
                    yield held * lines, matrices
                held, matrices = int(panel[start]), [np.zeros((lines, n), NUMPY[kind]) for n in sides]
            part = batch.iloc[start:end]
            value = part["re"].to_numpy() + 1j * part["im"].to_numpy() if kind is complex else part["re"].to_numpy()
            for k, matrix in enumerate(matrices):
                own = part["side"].to_numpy() == k
                matrix[part["line"].to_numpy()[own] - held * lines, part["at"].to_numpy()[own]] = value[own]
    if matrices is not None:
        yield held * lines, matrices


def _cells(df, line: str, at: str, value: str, side: int, lines: int, kind):
    """Cells of one factor as _panels() takes them."""
    v = F.col(value)
    parts = (v["re"].alias("re"), v["im"].alias("im")) if kind is complex else (v.alias("re"), F.lit(0.0).alias("im"))
    return df.select(F.call_function("div", F.col(line), F.lit(lines).cast("bigint")).alias("panel"), F.col(line).alias("line"), F.lit(side).alias("side"), F.col(at).alias("at"), *parts)


def _frame(first: int, matrix: np.ndarray, kind) -> pd.DataFrame:
    rows, columns = np.indices(matrix.shape)
    flat = matrix.ravel()
    parts = {"re": flat.real, "im": flat.imag} if kind is complex else {"re": flat, "im": 0.0}
    return pd.DataFrame({"r": rows.ravel() + first, "c": columns.ravel(), **parts})


def _value(kind):
    return F.struct("re", "im") if kind is complex else F.col("re")


def _small_result(x, y, kind, rows: int, columns: int):
    """r, c and v of x (r, k, x) @ y (k, c, y) where the result is small and k long: panels of lines of k are multiplied, a task adds
    up what its panels give, and the tasks' results are added up."""
    lines = max(1, PANEL_CELLS // (rows + columns))

    def run(batches):
        total = None
        for _, (a, b) in _panels(batches, (rows, columns), lines, kind):
            total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield _frame(0, total, kind)

    both = _cells(x, "k", "r", "x", 0, lines, kind).unionByName(_cells(y, "k", "c", "y", 1, lines, kind))
    found = both.repartition("panel").sortWithinPartitions("panel").mapInPandas(run, f"r bigint, c bigint, re {'bigint' if kind is int else 'double'}, im double")
    return found.groupBy("r", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).select("r", "c", _value(kind).alias("v"))


def _small_factor(x, y, kind, shape):
    """r, c and v of x (r, k, x) @ y (k, c, y) where y is small: it goes to all tasks, by a job, and panels of rows of x meet it.
    shape is (rows, inner, columns)."""
    rows, inner, columns = shape
    lines, matrix = max(1, PANEL_CELLS // (inner + columns)), np.zeros((inner, columns), NUMPY[kind])
    for r in y.collect():  # HELD_CELLS at most
        matrix[r["k"], r["c"]] = complex(r["y"]["re"], r["y"]["im"]) if kind is complex else r["y"]
    shared = x.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        for first, (a,) in _panels(batches, (inner,), lines, kind):
            yield _frame(first, (a @ shared.value)[: rows - first], kind)

    dealt = _cells(x, "r", "k", "x", 0, lines, kind).repartition("panel").sortWithinPartitions("panel")
    found = dealt.mapInPandas(run, f"r bigint, c bigint, re {'bigint' if kind is int else 'double'}, im double")
    return found.select("r", "c", _value(kind).alias("v"))


def _flat_batch(a: NDArray) -> NDArray:
    """a without its batch axes' repetitions; repeated rows or columns get cells."""
    if not a.repeats:
        return a
    return repeats.narrow(a) if None not in a.repeats[1][-2:] else NDArray(*a.cells[:2], a.shape, a.dtype, a.cells[2])


@values.plan
def matmul(a: NDArray, b: NDArray, lazy: bool = False):
    """Rows of a against columns of b; batch axes broadcast, vectors lose their axis again.

    Cells are joined on the contracted index, one row for each product, which Spark sums up within tasks before the shuffle; a batch
    axis of one operand alone isn't copied for the other. Where the products would be too many, a small result is summed up in each
    task from panels of rows, a small factor meets panels of the other, and tiles are joined if no side is small."""
    kind = values.promote(a.dtype, b.dtype)
    values.refuse(kind, bool, name="matmul")
    if not a.ndim or not b.ndim:
        raise ShapeError("matmul takes arrays of one or more axes")
    left = manipulation.reshape(a, (1, a.size)) if a.ndim == 1 else a
    right = manipulation.reshape(b, (b.size, 1)) if b.ndim == 1 else b
    if left.shape[-1] != right.shape[-2]:
        raise ShapeError(f"matmul inner dimensions differ: {a.shape} and {b.shape}")
    batch = geometry.broadcast(left.shape[:-2], right.shape[:-2])
    shape = batch + (left.shape[-2], right.shape[-1])
    drop = ([len(shape) - 2] if a.ndim == 1 else []) + ([len(shape) - 1] if b.ndim == 1 else [])
    out = tuple(n for k, n in enumerate(shape) if k not in drop)
    spark = a.session
    if not left.shape[-1] or 0 in out:
        from gridloom.sources.creation import zeros

        return unwrapped(zeros(spark, out, kind), lazy)
    left, right = _flat_batch(left), _flat_batch(right)
    names = [f"b{k}" for k in range(len(batch))]
    rows, inner, columns = left.shape[-2], left.shape[-1], right.shape[-1]
    many = prod(shape) * inner > JOINED_PRODUCTS
    tiled = many and min(rows, inner, columns) >= TILE and (batch or rows * columns > HELD_CELLS)
    if tiled:
        left, right = (manipulation.broadcast_to(m, batch + m.shape[-2:]) for m in (left, right))

    def own(m: NDArray, line: str, at: str, value: str):
        """The cells of m with the batch axes that it has, and their names."""
        pad = len(batch) - (m.ndim - 2)
        has = {names[k + pad]: f"i{k}" for k in range(m.ndim - 2) if tiled or m.shape[k] != 1}
        ends = (F.col(f"i{m.ndim - 2}").alias(line), F.col(f"i{m.ndim - 1}").alias(at))
        return m.base.select(*(F.col(i).alias(n) for n, i in has.items()), *ends, values.cast(m.value, m.dtype, kind).alias(value)), has

    (x, x_has), (y, y_has) = own(left, "r", "k", "x"), own(right, "k", "c", "y")
    if tiled:
        found = _tiled(x, y, names, kind, shape[-2:])
    elif many and not batch and rows * columns <= HELD_CELLS:
        found = _small_result(x, y, kind, rows, columns)
    elif many and not batch and inner * columns <= HELD_CELLS:
        found = _small_factor(x, y, kind, (rows, inner, columns))
    elif many and not batch and rows * inner <= HELD_CELLS:  # the transposed product
        turned = _small_factor(y.select("k", F.col("c").alias("r"), F.col("y").alias("x")), x.select("k", F.col("r").alias("c"), F.col("x").alias("y")), kind, (columns, inner, rows))
        found = turned.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")
    else:
        have = [n for n in names if n in x_has or n in y_has]
        joined = x.join(y, [*(n for n in have if n in x_has and n in y_has), "k"])
        found = joined.groupBy(*have, "r", "c").agg(_contracted(kind, F.col("x"), F.col("y")).alias("v"))
        found = found.select(*(F.col(n) if n in have else F.lit(0).cast("bigint").alias(n) for n in names), "r", "c", "v")
    met = [names[k] in x_has or names[k] in y_has or batch[k] == 1 for k in range(len(batch))]  # else both repeat along it
    kept = [n for k, n in enumerate([*names, "r", "c"]) if k not in drop]
    own_shape = tuple(n if k >= len(batch) or met[k] else 1 for k, n in enumerate(shape) if k not in drop)
    result = NDArray.of(found.select(*(F.col(n).alias(f"i{k}") for k, n in enumerate(kept)), "v"), own_shape, kind)
    return unwrapped(result if own_shape == out else repeats.stretched(result, out), lazy)


def dot(a: NDArray, b: NDArray, lazy: bool = False):
    if not (1 <= a.ndim <= 2 and 1 <= b.ndim <= 2):
        raise ShapeError("dot supports only 1-D or 2-D operands")
    return matmul(a, b, lazy)


def vdot(a: NDArray, b: NDArray, lazy: bool = False):
    """Flat, the first one conjugated. Arrays of one shape are multiplied cell by cell, over one base without a join."""
    if a.size != b.size:
        raise ShapeError("vdot requires equal flattened sizes")
    from gridloom.operators import ufunc

    values.refuse(values.promote(a.dtype, b.dtype), bool, name="vdot")
    a = ufunc.conj(a) if a.dtype is complex else a
    if a.shape != b.shape:
        a, b = manipulation.reshape(a, (a.size,)), manipulation.reshape(b, (b.size,))
    return reduction.sum(ufunc.multiply(a, b), lazy=lazy)


def outer(a: NDArray, b: NDArray) -> NDArray:
    return manipulation.reshape(a, (a.size, 1)) * manipulation.reshape(b, (1, b.size))


@values.plan
def diagonal(a: NDArray, offset: int = 0, axis1: int = 0, axis2: int = 1) -> NDArray:
    """The diagonal's axis comes last."""
    if a.ndim < 2:
        raise ShapeError("diagonal takes arrays of two or more axes")
    p, q = geometry.normal_axis(axis1, a.ndim), geometry.normal_axis(axis2, a.ndim)
    if p == q:
        raise ShapeError("axis1 and axis2 must be different")
    n = max(0, min(a.shape[p] - max(-offset, 0), a.shape[q] - max(offset, 0)))
    kept = [k for k in range(a.ndim) if k not in (p, q)]
    cells = a.base.filter(F.col(f"i{q}") - F.col(f"i{p}") == offset)
    found = cells.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)), (F.col(f"i{p}") - max(-offset, 0)).alias(f"i{len(kept)}"), a.value.alias("v"))
    return NDArray(found, F.col("v"), tuple(a.shape[k] for k in kept) + (n,), a.dtype, True, a.read_only)


def trace(a: NDArray, offset: int = 0, axis1: int = 0, axis2: int = 1, lazy: bool = False):
    d = diagonal(a, offset, axis1, axis2)
    return reduction.sum(d, axis=d.ndim - 1, lazy=lazy)
