"""Products of long and thin matrices, batches, hot index arrays, and assignment of large arrays, against NumPy."""

import numpy as np
import pytest

from gridloom.operators import indexing, linalg, manipulation, ufunc
from gridloom.sources import creation
from tests.test_arrays import same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", [int, float, complex])
def test_panels(spark, monkeypatch, kind):
    monkeypatch.setattr(linalg, "JOINED_PRODUCTS", 0)
    monkeypatch.setattr(linalg, "PANEL_CELLS", 40)
    rng = np.random.default_rng(3)
    x, y = ((rng.integers(-(1 << 40) if kind is int else -9, 1 << 40 if kind is int else 9, s) * (1 + 2j if kind is complex else 1)).astype(kind) for s in ((50, 4), (50, 3)))
    a, b = (creation.array(spark, m.tolist(), kind) for m in (x, y))
    product = a.T @ b
    assert "Join" not in plan(product.df) and "panel" in plan(product.df)
    with np.errstate(over="ignore"):
        same(product, x.T @ y)
        monkeypatch.setattr(linalg, "HELD_CELLS", 12)  # too few for the results that follow
        small = y[:3]
        c = creation.array(spark, small.tolist(), kind)  # 3 x 3
        same(b @ c, y @ small)
        same(c @ b.T, small @ y.T)
        assert "Join" not in plan((b @ c).df) and "Join" not in plan((c @ b.T).df)


def test_a_tall_product_makes_no_row_for_each_product(spark):
    n = 100_000
    m = creation.from_dataframe(spark.range(n * 30).selectExpr("id div 30 AS r", "id % 30 AS c", "id * 7 % 11 AS x"), ["r", "c"], "x", (n, 30), check=False)
    found = m.T @ m  # 90 million products
    assert "Join" not in plan(found.df)
    x = (np.arange(n * 30) * 7 % 11).reshape(n, 30)
    same(found, x.T @ x)


def test_batches_are_not_copied(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, (2, 1, 3, 4)), rng.integers(0, 9, (5, 4, 2))
    a, b = creation.array(spark, x.tolist()), creation.array(spark, y.tolist())
    found = a @ b
    assert plan(found.df).count("Join") == 1
    same(found, x @ y)
    same(manipulation.broadcast_to(b, (3, 5, 4, 2))[:, :1] @ creation.ones(spark, 2, int), np.broadcast_to(y, (3, 5, 4, 2))[:, :1] @ np.ones(2, int))
    same(creation.ones(spark, (1, 1, 2), int) @ manipulation.broadcast_to(creation.arange(spark, 3), (2, 3)), np.ones((1, 1, 2), int) @ np.broadcast_to(np.arange(3), (2, 3)))
    same(a[:1] @ b[:1], x[:1] @ y[:1])


def test_hot_index_arrays(spark, monkeypatch):
    x = np.arange(60).reshape(20, 3)
    picks = np.array([[0] * 30 + [5, 19, 5]] * 2)
    a, p = creation.array(spark, x.tolist()), creation.array(spark, picks.tolist())
    same(a[p], x[picks])
    assert "BroadcastHashJoin" in plan(a[p].df)
    monkeypatch.setattr(ufunc, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(indexing, "HOT_PICKS", 8)
    same(a[p], x[picks])
    same(a[p, creation.array(spark, [1])], x[picks, [1]])
    same(a[:, None, creation.array(spark, [2, 2, 2, 2, 2, 2, 2, 2, 2, 0])], x[:, None, [2] * 9 + [0]])


def test_hot_picks_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ufunc, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(indexing, "HOT_PICKS", 1000)
    n = 200_000
    cells, picks = spark.range(50).selectExpr("id AS i0", "id * 3 AS v"), spark.range(n).selectExpr("id AS f0", "CASE WHEN id % 100 = 0 THEN id % 50 ELSE 7 END AS i0")
    found = indexing._gathered(cells, picks, ["i0"], 50, n, 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == n and max(sizes) < n / 2


def test_large_values_meet_selected_cells_only(spark, monkeypatch):
    monkeypatch.setattr(ufunc, "BROADCAST_CELLS", 1)
    x, new = np.arange(24).reshape(2, 3, 4), np.arange(100, 108).reshape(2, 4)
    a, b = creation.arange(spark, 24).reshape(2, 3, 4), creation.array(spark, new.tolist())
    y = x.copy()
    y[:, 1] = new
    same(indexing.assigned(a, (slice(None), 1), b), y)
    y[:, ::2] = new[:1]
    same(indexing.assigned(indexing.assigned(a, (slice(None), 1), b), (slice(None), slice(None, None, 2)), b[:1]), y)
    y = x.copy()
    y[[1, 0, 1]] = new[:1]
    same(indexing.assigned(a, creation.array(spark, [1, 0, 1]), b[:1]), y)
