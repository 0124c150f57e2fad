"""Whitening of vectors onto their leading components.

One pass over the vectors gives exact sums, a second their centred covariance, summed up from a matrix a task. The driver
finds the leading eigenpairs of that matrix, whose size depends on the vectors' length alone; they are broadcast, and vectors
are projected in tasks.
"""

from __future__ import annotations

import decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import eigen

#: Entries are whole numbers floor(SCALE * c) + SHIFT, and those beyond LIMIT count as LIMIT.
SCALE, SHIFT, LIMIT = 1024.0, 100_000, 1 << 61
#: Eigenvalues below this share of the trace are taken from the projections' own variance, those below the second are none.
REFINED, NONE = 1e-8, 1e-20
COLUMNS = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id (as text) and vector (doubles), of the rows whose vector has finite entries only, and at least one."""
    vector = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("string").alias("vec_id"), vector.alias("vector"), F.coalesce(finite, F.lit(False)).alias("finite"))
    return rows.filter(F.col("finite") & (F.size("vector") > 0)).drop("finite")


def whole(vectors: list) -> np.ndarray:
    """x of vectors of one length, a row each."""
    found = np.floor(SCALE * np.stack(vectors))
    return np.clip(found, -float(LIMIT), float(LIMIT)).astype("int64") + SHIFT


def _sums(batches):
    totals: dict[int, list] = {}
    for batch in batches:
        sizes = batch["vector"].map(len).to_numpy()
        for size in np.unique(sizes):
            x = whole(batch["vector"][sizes == size].tolist())
            if int(np.abs(x).max()) * len(x) < 1 << 62:
                s = [int(v) for v in x.sum(axis=0)]
            else:
                s = [sum(map(int, column)) for column in x.T]
            n, old = totals.get(int(size), (0, [0] * int(size)))
            totals[int(size)] = (n + len(x), [a + b for a, b in zip(old, s)])
    for size, (n, s) in totals.items():
        yield pd.DataFrame({"size": size, "k": np.arange(size), "n": n, "s": [decimal.Decimal(v) for v in s]})


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of the vectors of the commonest length (of equally common ones the least)."""
    sums = rows.select("vector").mapInPandas(_sums, "size int, k int, n bigint, s decimal(38,0)")
    totals = sums.groupBy("size", "k").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    best = totals.filter("k = 0").orderBy(F.desc("n"), "size").first()
    if best is None:
        return 0, []
    found = totals.filter(F.col("size") == best["size"]).orderBy("k").collect()
    return int(best["n"]), [int(r["s"]) for r in found]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: first less the nearest whole number to the mean, so that nothing is lost to large means."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([float(s - n * m) / n if abs(s - n * m) < 1 << 53 else (s - n * m) / n for s, m in zip(sums, near)])
    return (x - np.array(near, "int64")).astype(float) - rest


def covariance(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray | None = None) -> np.ndarray:
    """Of x - S / n (projected on the columns of axes, if given), divisor n: products of centred numbers, a matrix a task."""
    size, out = len(sums), len(sums) if axes is None else axes.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((sums, axes))
    upper = np.triu_indices(out)

    def work(batches):
        sums, axes = shared.value
        total = np.zeros((out, out))
        for batch in batches:
            c = centred(whole(batch["vector"].tolist()), n, sums)
            c = c if axes is None else c @ axes
            total += c.T @ c
        yield pd.DataFrame({"cell": np.arange(len(upper[0])), "v": total[upper]})

    cells = rows.filter(F.size("vector") == size).select("vector").mapInPandas(work, "cell bigint, v double")
    found = cells.groupBy("cell").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((out, out))
    for r in found:
        matrix[upper[0][r["cell"]], upper[1][r["cell"]]] = r["v"]
    return (matrix + np.triu(matrix, 1).T) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sums over dimensions of (n x - S)^2, exact at any size."""
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if most < 1 << 62:
        y = n * x - np.array(sums, "int64")
        if int(np.abs(y).max()) ** 2 * len(sums) < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in y.tolist()]
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits: a row for each usable row and
    component; repeated rows give repeated rows.

    Rows whose vector is null, empty, or has a null or non-finite entry are dropped, and so are those of another length than
    the commonest (of equally common ones the least), as no covariance has both. Entries beyond 2**61 after scaling count as
    that. A null id is kept. An empty table, and one whose vectors are all equal, has no component and gives no rows; a
    component without variance gives none. deviation is the nearest 64-bit number where the exact one, which
    deviation_digits has, needs more. Other columns of the table are not read.
    """
    spark = table.sparkSession
    kind = dict(table.dtypes)[id_col]
    rows = usable(table, id_col, vector_col)
    n, sums = exact_sums(rows)
    matrix = covariance(rows, n, sums) if n else np.zeros((0, 0))
    trace = float(np.trace(matrix))
    found, axes = eigen.leading(matrix, components)
    if trace > 0:
        spread = covariance(rows, n, sums, axes)
        own = np.diagonal(spread)
        found = np.where(found < REFINED * trace, own, found)
        kept = np.flatnonzero(found > NONE * trace)
        kept = kept[np.argsort(-found[kept], kind="stable")]
        found, axes, spread = found[kept], axes[:, kept], spread[np.ix_(kept, kept)]
    if not trace > 0 or not len(found):
        return spark.createDataFrame([], COLUMNS.format(kind))
    root = np.sqrt(found)
    error = float(np.abs(spread / np.outer(root, root) - np.eye(len(root))).max())
    size, shared = len(sums), spark.sparkContext.broadcast((sums, axes / root))

    def project(batches):
        sums, scaled = shared.value
        for batch in batches:
            x = whole(batch["vector"].tolist())
            exact = deviations(x, n, sums)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"], "deviation": [min(v, (1 << 63) - 1) for v in exact], "deviation_digits": [str(v) for v in exact],
                "whitened": list(centred(x, n, sums) @ scaled),
            })

    out = rows.filter(F.size("vector") == size).mapInPandas(project, "vec_id string, deviation bigint, deviation_digits string, whitened array<double>")
    share = F.array(*(F.lit(float(v / trace)) for v in found))
    return out.select("vec_id", "deviation", "deviation_digits", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("vec_id").cast(kind).alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_digits",
    )
