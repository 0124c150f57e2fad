"""Ranks by tables of bounds, and distinct values with their places, against NumPy."""

import numpy as np
import pytest

from gridloom.operators import sorting, ufunc
from gridloom.sources import creation, scratch
from tests.test_arrays import same

NAN = float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(kind, rng):
    if kind is bool:
        return rng.integers(0, 2, (6, 20)).astype(bool)
    x = rng.integers(-4, 9, (6, 20))
    if kind is complex:
        return x + 1j * rng.integers(0, 3, (6, 20))
    x = x.astype(kind)
    if kind is float:
        x[0, :7] = NAN
        x[1, 2:5] = -0.0
    return x


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("kind", [bool, int, float, complex])
def test_unique_with(spark, monkeypatch, kind, small):
    if small:  # many buckets, hot values met apart
        for name, value in (("WINDOW_CELLS", 6), ("STEP", 2), ("HOT_CELLS", 9)):
            monkeypatch.setattr(sorting, name, value)
        monkeypatch.setattr(sorting, "CUTS", 4 if kind is float else 64)  # so that buckets are cut again
        monkeypatch.setattr(ufunc, "BROADCAST_CELLS", 1)
        monkeypatch.setattr(scratch, "DRIVER_VALUES", 0)
    x = drawn(kind, np.random.default_rng(8))
    found = sorting.unique_with(creation.array(spark, x.tolist()), return_index=True, return_inverse=True, return_counts=True)
    values, indices, inverse, counts = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    same(found.values, values)
    same(found.indices, indices)
    same(found.inverse, inverse.ravel())
    same(found.counts, counts)
    assert found.values.base is found.indices.base is found.counts.base


def test_unique_with_options_and_edges(spark):
    a = creation.array(spark, [2, 1, 2])
    found = sorting.unique_with(a)
    assert found.values.to_list() == [1, 2] and found.indices is found.inverse is found.counts is None
    assert sorting.unique_with(a, return_inverse=True).inverse.to_list() == [1, 0, 1]
    empty = sorting.unique_with(creation.zeros(spark, (0, 3)), True, True, True)
    assert [x.to_list() for x in empty] == [[], [], [], []]
    assert sorting.unique_with(creation.array(spark, [NAN, NAN]), return_counts=True).counts.to_list() == [2]


def test_plans_do_not_grow(spark, monkeypatch):
    """The plan of a long sort is as large as that of a shorter one, windows are bounded, and no task gets all cells."""
    table = spark.range(20_000).selectExpr("id", "id * 7919 % 20011 AS x")
    sizes = {}
    for cells in (200, 60, 20):
        monkeypatch.setattr(sorting, "WINDOW_CELLS", cells)
        monkeypatch.setattr(sorting, "CUTS", 1 << 12)
        a = creation.from_dataframe(table, ["id"], "x", (20_000,), check=False)
        df = sorting.argsort(a).df
        sizes[cells] = len(df._jdf.queryExecution().optimizedPlan().toString())
        assert "SinglePartition" not in plan(df)
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert "SinglePartition" not in plan(sorting.unique_with(a, True, True, True).inverse.df)
    x = np.array([k * 7919 % 20011 for k in range(20_000)])
    assert [r["v"] for r in sorting.sort(a).df.orderBy("i0").collect()] == sorted(x.tolist())


def test_windows_of_slices_with_other_values(spark, monkeypatch):
    """Each slice has cuts of its own: 16 slices whose values don't overlap, and one value that fills a slice."""
    monkeypatch.setattr(sorting, "WINDOW_CELLS", 64)
    x = np.arange(16 * 1000).reshape(16, 1000) * 31 % 1000 + 1000 * np.arange(16).reshape(16, 1)
    x[5] = 7
    a = creation.from_dataframe(spark.createDataFrame([(r, c, int(x[r, c])) for r in range(16) for c in range(1000)], "r long, c long, x long"), ["r", "c"], "x", (16, 1000), check=False)
    windows = []
    original = sorting._placed
    monkeypatch.setattr(sorting, "_placed", lambda dealt, keys, own, order, n: windows.append(dealt.groupBy(*keys, *own).count().agg({"count": "max"}).first()[0]) or original(dealt, keys, own, order, n))
    same(sorting.argsort(a, axis=1), np.argsort(x, axis=1, kind="stable"))
    assert windows and windows[0] <= 2 * 64
