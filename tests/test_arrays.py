"""Differential tests against NumPy on small arrays."""

import numpy as np
import pytest

from gridloom import geometry
from gridloom.errors import ArrayIndexError, AxisError, DTypeError, DivideByZeroError, ShapeError, UnsupportedError
from gridloom.operators import indexing, iteration, linalg, manipulation, reduction, selection, sorting, ufunc
from gridloom.ndarray import NDArray
from gridloom.sources import creation

NAN = float("nan")


def same(a, want):
    want = np.asarray(want)
    if not isinstance(a, NDArray):  # a scalar
        assert want.shape == () and isinstance(a, (bool, int, float, complex))
        np.testing.assert_allclose(a, want, rtol=1e-12, atol=1e-12)
        return
    got = np.array(a.to_list()).reshape(a.shape)
    assert a.shape == want.shape
    np.testing.assert_allclose(got.astype(want.dtype), want, rtol=1e-12, atol=1e-12)


@pytest.fixture(scope="module")
def cube(spark):
    return creation.arange(spark, 24).reshape(2, 3, 4), np.arange(24).reshape(2, 3, 4)


@pytest.mark.parametrize("name", ["add", "subtract", "multiply", "divide", "power"])
@pytest.mark.parametrize("kind", [float, complex])
def test_arithmetic(spark, name, kind):
    x, y = [[9, 4, 1], [6, 8, 5]], [3, 1, 2]
    same(getattr(ufunc, name)(creation.array(spark, x, kind), creation.array(spark, y, kind)), getattr(np, name)(np.array(x, kind), np.array(y, kind)))


def test_integers_wrap_and_truncate(spark):
    top = (1 << 63) - 1
    a = creation.array(spark, [top, -top - 1, 7, -7])
    assert (a + 1).to_list() == [-top - 1, -top, 8, -6]
    assert abs(a).to_list() == [top, -top - 1, 7, 7]
    b = creation.array(spark, [7, -7])
    assert (b / 2).to_list() == [3, -3] and (b // 2).to_list() == [3, -3] and (b % 4).to_list() == [3, -3]
    assert (creation.array(spark, [3, -3, 2]) ** creation.array(spark, [40, 41, 63])).to_list() == [3**40 - (1 << 64) * ((3**40 + (1 << 63)) >> 64), *((v + (1 << 63)) % (1 << 64) - (1 << 63) for v in ((-3) ** 41, 1 << 63))]
    with pytest.raises(DivideByZeroError):
        b / 0
    with pytest.raises(UnsupportedError):
        b ** -1
    with pytest.raises(UnsupportedError):
        creation.array(spark, [True]) + creation.array(spark, [True])


def test_ieee(spark):
    x = np.array([1.0, NAN, -0.0, float("inf"), -1.0])
    a = creation.array(spark, x.tolist())
    with np.errstate(all="ignore"):
        same(a / 0.0, x / 0.0)
        same(a**0.5, np.where(x == -1, NAN, x**0.5))
    for name in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"):
        assert getattr(ufunc, name)(a, a).to_list() == getattr(np, name)(x, x).tolist()
    assert ufunc.isnan(a).to_list() == np.isnan(x).tolist() and ufunc.isfinite(a).to_list() == np.isfinite(x).tolist()
    assert selection.clip(a, -0.5, 0.5).to_list()[0] == 0.5 and np.isnan(selection.clip(a, -0.5, 0.5).to_list()[1])
    same(a.astype(int), [1, 0, 0, (1 << 63) - 1, -1])


def test_broadcasting(spark):
    x, y = np.arange(3).reshape(3, 1), np.arange(2) * 10.5
    same(creation.array(spark, x.tolist()) + creation.array(spark, y.tolist()), x + y)
    same(manipulation.broadcast_to(creation.array(spark, [1, 2]), (2, 3, 2)), np.broadcast_to([1, 2], (2, 3, 2)))
    with pytest.raises(ShapeError):
        creation.array(spark, [1, 2]) + creation.array(spark, [1, 2, 3])


@pytest.mark.parametrize("axis", [None, 0, 1, 2, (0, 2)])
def test_reductions(cube, axis):
    a, x = cube
    for name in ("sum", "min", "max", "mean", "var", "std", "prod"):
        y = x % 5 + 1 if name == "prod" else x
        b = a % 5 + 1 if name == "prod" else a
        same(getattr(reduction, name)(b, axis=axis), getattr(np, name)(y, axis=axis))
    same(reduction.sum(a, axis=axis, keepdims=True), x.sum(axis=axis, keepdims=True))
    same(reduction.any(a > 20, axis=axis), (x > 20).any(axis=axis))
    same(reduction.all(a > 0, axis=axis), (x > 0).all(axis=axis))


def test_nan_policies(spark):
    x = np.array([[1, NAN, 3], [NAN, NAN, NAN]])
    a = creation.array(spark, x.tolist())
    same(reduction.sum(a, axis=1), x.sum(axis=1))
    for name in ("sum", "prod", "min", "max", "mean"):
        same(getattr(reduction, name)(a, axis=1, nan_policy="ignore"), [{"sum": 4, "prod": 3, "min": 1, "max": 3, "mean": 2}[name], NAN])
    assert reduction.argmax(a, axis=1).to_list() == [1, 0]
    with pytest.raises(UnsupportedError):
        reduction.argmin(a, axis=1, nan_policy="ignore")
    same(reduction.cumsum(creation.array(spark, [NAN, 2.0, NAN, 3.0]), nan_policy="ignore"), [NAN, 2, 2, 5])


def test_empty_axes(spark):
    empty = creation.zeros(spark, (2, 0))
    assert reduction.sum(empty, axis=1).to_list() == [0, 0] and reduction.all(empty, axis=1).to_list() == [True, True]
    with pytest.raises(ShapeError):
        reduction.max(empty, axis=1)
    assert linalg.matmul(empty, creation.zeros(spark, (0, 3))).shape == (2, 3)


def test_scans(cube, spark, monkeypatch):
    a, x = cube
    same(reduction.cumsum(a), x.cumsum())
    same(reduction.cumsum(a, axis=1), x.cumsum(axis=1))
    same(reduction.cumprod(a + 1, axis=2), (x + 1).cumprod(axis=2))
    monkeypatch.setattr(reduction, "SCAN_BLOCK", 4)
    same(reduction.cumsum(a), x.cumsum())


def test_sorting(cube, spark, monkeypatch):
    values = [3, 1, 3, 2, 1, 3, 3, 3, 0, 2] * 5
    a, x = creation.array(spark, values), np.array(values)
    monkeypatch.setattr(sorting, "WINDOW_CELLS", 7)
    monkeypatch.setattr(sorting, "STEP", 3)
    same(sorting.sort(a), np.sort(x))
    same(sorting.argsort(a), np.argsort(x, kind="stable"))
    same(sorting.unique(a), np.unique(x))
    f = [2.0, NAN, -1.0, NAN, 2.0, 5.0, 0.5, 2.0, 2.0]
    same(sorting.sort(creation.array(spark, f)), np.sort(f))
    same(sorting.argsort(creation.array(spark, [f]), axis=1), np.argsort([f], axis=1, kind="stable"))


KEYS = [(0,), (slice(None), 1), (Ellipsis, slice(3, None, -2)), (slice(None), None, -1), (1, slice(0, 2), slice(1, 9))]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_basic_indexing(cube, key):
    a, x = cube
    same(a[key], x[key])


def test_fancy_indexing(cube, spark):
    a, x = cube
    i, j = [[2, 0], [1, -1]], [1, 3]
    same(a[:, creation.array(spark, i)], x[:, np.array(i)])
    same(a[:, creation.array(spark, i), creation.array(spark, j)], x[:, np.array(i), np.array(j)])
    same(a[creation.array(spark, [1, 0]), :, creation.array(spark, j)], x[np.array([1, 0]), :, np.array(j)])
    same(a[a % 5 == 0], x[x % 5 == 0])
    with pytest.raises(ArrayIndexError):
        a[:, creation.array(spark, [3])]
    with pytest.raises(ArrayIndexError):
        a[2]


def test_assignment(cube, spark):
    a, x = cube
    b, y = a.astype(float), x.astype(float)
    c, z = b, y.copy()
    changed = indexing.assigned(c, (slice(None), 1), 7)
    z[:, 1] = 7
    same(changed, z)
    same(b, y)
    v = creation.arange(spark, 10)
    same(indexing.assigned(v, creation.array(spark, [3, 3, 5]), creation.array(spark, [30, 31, 50])), [0, 1, 2, 31, 4, 50, 6, 7, 8, 9])
    same(indexing.assigned(v, v > 6, -1), [0, 1, 2, 3, 4, 5, 6, -1, -1, -1])
    v[2] = 9
    assert v.to_list()[2] == 9


def test_manipulation(cube, spark):
    a, x = cube
    same(a.reshape(4, -1), x.reshape(4, -1))
    same(a.T, x.T)
    same(a.permute_axes((1, 2, 0)), x.transpose(1, 2, 0))
    same(manipulation.concatenate([a, a], 1), np.concatenate([x, x], 1))
    same(manipulation.stack([a, a], 2), np.stack([x, x], 2))
    same(manipulation.hstack([a[0], a[1]]), np.hstack([x[0], x[1]]))
    assert a.reshape(1, 24).squeeze().shape == (24,)
    with pytest.raises(AxisError):
        reduction.sum(a, axis=3)
    with pytest.raises(ShapeError):
        geometry.reshaped((2, 3), (4, -1))


def test_linear_algebra(spark):
    x, y = np.arange(24).reshape(2, 3, 4), np.arange(8).reshape(4, 2)
    a, b = creation.array(spark, x.tolist()), creation.array(spark, y.tolist())
    same(a @ b, x @ y)
    same(a @ creation.arange(spark, 4), x @ np.arange(4))
    same(linalg.outer(b[0], b[1]), np.outer(y[0], y[1]))
    same(linalg.diagonal(a, 1, 1, 2), x.diagonal(1, 1, 2))
    same(linalg.trace(a, 0, 0, 2), x.trace(0, 0, 2))
    u = [1 + 2j, 3 - 1j]
    assert linalg.vdot(creation.array(spark, u), creation.array(spark, u)) == np.vdot(u, u)


def test_creation(spark):
    same(creation.linspace(spark, -1, 2, 5), np.linspace(-1, 2, 5))
    same(creation.linspace(spark, 0, 3, 4, endpoint=False), np.linspace(0, 3, 4, endpoint=False))
    same(creation.logspace(spark, 0, 2, 3), np.logspace(0, 2, 3))
    same(creation.geomspace(spark, -1, -8, 4), np.geomspace(-1, -8, 4))
    same(creation.eye(spark, 3, 4, 1), np.eye(3, 4, 1))
    same(creation.tri(spark, 3, 4, -1), np.tri(3, 4, -1))
    same(creation.triu(creation.arange(spark, 6).reshape(2, 3)), np.triu(np.arange(6).reshape(2, 3)))
    same(creation.diag(creation.arange(spark, 3), 1), np.diag(np.arange(3), 1))
    for a, x in zip(creation.meshgrid(creation.arange(spark, 2), creation.arange(spark, 3)), np.meshgrid(np.arange(2), np.arange(3))):
        same(a, x)
    assert creation.arange(spark, 5, 0, -2).to_list() == [5, 3, 1]
    with pytest.raises(ShapeError):
        creation.array(spark, [[1, 2], [3]])
    with pytest.raises(TypeError):
        creation.zeros(spark, 3, "float64")


def test_from_dataframe_checks_cells(spark):
    rows = spark.createDataFrame([(0, 1.5), (1, None), (2, 2.5)], "k int, v double")
    same(creation.from_dataframe(rows, ["k"], "v", 3), [1.5, NAN, 2.5])
    for bad in ([(0, 1), (0, 2)], [(0, 1)], [(0, 1), (5, 1)], [(0, None), (1, 1)]):
        with pytest.raises(ShapeError):
            creation.from_dataframe(spark.createDataFrame(bad, "k int, v int"), ["k"], "v", 2)


def test_shared_base_needs_no_join(spark):
    rows = spark.range(5).selectExpr("id AS k", "id AS a", "id * 2 AS b")
    a, b = creation.from_dataframe(rows, ["k"], ["a", "b"], 5)
    plan = (a * b + 1).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_iteration(spark):
    a = creation.arange(spark, 4).reshape(2, 2)
    assert list(iteration.ndindex((2, 1))) == [(0, 0), (1, 0)]
    assert list(iteration.ndenumerate(a))[3] == ((1, 1), 3) and list(iteration.flat(a)) == [0, 1, 2, 3]
    assert list(iteration.nditer((a, creation.arange(spark, 2))))[2] == (2, 0)


def test_scans_in_blocks(cube, spark, monkeypatch):
    a, x = cube
    monkeypatch.setattr(reduction, "SCAN_BLOCK", 3)
    monkeypatch.setattr(reduction, "FOLD_BLOCK", 3)
    for axis in (None, 0, 1, 2):
        same(reduction.cumsum(a, axis=axis), x.cumsum(axis=axis))
        same(reduction.cumprod(a * 7 + 3, axis=axis), (x * 7 + 3).cumprod(axis=axis))
        same(reduction.cumprod(a.astype(float) / 9, axis=axis), (x / 9).cumprod(axis=axis))
        same(reduction.prod(a * 7 + 3, axis=axis), (x * 7 + 3).prod(axis=axis))
        z = ufunc.complex_of(a, a % 3) * 0.5
        w = (x + x % 3 * 1j) * 0.5
        same(reduction.cumsum(z, axis=axis), w.cumsum(axis=axis))
        same(reduction.cumprod(z + 1, axis=axis), (w + 1).cumprod(axis=axis))
        same(reduction.prod(z + 1, axis=axis), (w + 1).prod(axis=axis))
    f = [NAN, 2.0, NAN, 3.0, 0.5, NAN, 4.0]
    same(reduction.cumsum(creation.array(spark, f), nan_policy="ignore"), [NAN, 2, 2, 5, 5.5, 5.5, 9.5])
    same(reduction.cumprod(creation.array(spark, f), nan_policy="ignore"), [NAN, 2, 2, 6, 3, 3, 12])
    same(reduction.cumsum(creation.array(spark, f)), np.cumsum(f))
    c = creation.array(spark, [complex(NAN, 0), 2j, complex(1, NAN), 3 + 0j])
    got = reduction.cumprod(c, nan_policy="ignore").to_list()
    assert np.isnan(got[0].real) and got[1:] == [2j, 2j, 6j] and reduction.prod(c, nan_policy="ignore") == 6j


@pytest.mark.parametrize("batch", [7, 10_000])
def test_running_products_of_many_slices(spark, batch):
    """A batch holds many slices, a slice may go on in the next batch, and no slice costs a call of its own."""
    rng = np.random.default_rng(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for shape in ((300, 4), (3, 70), (6, 3, 5)):
            x = rng.integers(-(1 << 40), 1 << 40, shape)
            z = np.exp(1j * rng.random(shape))
            a, c = creation.array(spark, x.tolist()), creation.array(spark, z.tolist())
            for axis in (None, *range(len(shape))):
                assert reduction.cumprod(a, axis=axis).to_list() == x.cumprod(axis=axis).tolist()
                same(reduction.cumprod(c, axis=axis), z.cumprod(axis=axis))
            assert "FlatMapGroups" not in reduction.cumprod(a, axis=0).df._jdf.queryExecution().executedPlan().toString()
            z[rng.random(shape) < 0.6] = NAN
            want = np.where(np.isnan(z), 1, z).cumprod(axis=-1)
            want[~np.logical_or.accumulate(~np.isnan(z), axis=-1)] = complex(NAN, NAN)
            same(reduction.cumprod(creation.array(spark, z.tolist()), axis=-1, nan_policy="ignore"), want)
        table = spark.range(24).selectExpr("id", "CASE WHEN id <> 5 THEN id + 1 END AS x")
        a = creation.from_dataframe(table, ["id"], "x", (24,), check=False)
        assert reduction.cumprod(a.reshape(12, 2), axis=1).to_list() == [[k + 1, (k + 1) * (k + 2)] if k != 4 else [5, None] for k in range(0, 24, 2)]
        assert reduction.cumprod(a.reshape(2, 12), axis=1).to_list()[0] == [1, 2, 6, 24, 120] + [None] * 7
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_sorting_of_long_axes(spark, monkeypatch):
    monkeypatch.setattr(sorting, "WINDOW_CELLS", 5)
    monkeypatch.setattr(sorting, "STEP", 3)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (3, 40)).astype(float)
    x[0, 4] = x[2, 7] = NAN
    a = creation.array(spark, x.tolist())
    for axis in (None, 0, 1):
        same(sorting.sort(a, axis=axis), np.sort(x, axis=axis))
        same(sorting.argsort(a, axis=axis), np.argsort(x, axis=axis, kind="stable"))
    same(sorting.sort(creation.array(spark, x[1].tolist())), np.sort(x[1]))
    z = (rng.integers(0, 4, 60) + 1j * rng.integers(0, 20, 60)).tolist()
    same(sorting.unique(creation.array(spark, z)), np.unique(z))
    same(sorting.unique(creation.array(spark, [True, False, True])), [False, True])


def test_masks_and_assignment(cube, spark, monkeypatch):
    monkeypatch.setattr(selection, "PLACE_BLOCK", 4)
    a, x = cube
    same(a[a % 5 > 2], x[x % 5 > 2])
    same(a[creation.array(spark, (x > 100).tolist())], x[x > 100])
    for got, want in zip(selection.nonzero(a % 3 == 1), np.nonzero(x % 3 == 1)):
        same(got, want)
    rng = np.random.default_rng(5)
    for key in (0, (slice(None), 1), (slice(None, None, -1), slice(2), slice(1, None, 2)), (Ellipsis, 3), (1, None, 2, slice(3)), (slice(5, 9),)):
        for value in (-1, rng.integers(0, 99, x[key].shape), rng.integers(0, 99, x[key].shape[-1:])):
            y = x.copy()
            y[key] = value
            same(indexing.assigned(a, key, value if isinstance(value, int) else creation.array(spark, value.tolist(), int)) if np.size(value) else a, y)
    y = x.copy()
    y[y > 11] = 5
    same(indexing.assigned(a, a > 11, 5), y)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_plans(spark, monkeypatch):
    """What needs no shuffle has none, and no plan puts all cells into one partition."""
    table = spark.range(1000).selectExpr("id", "id * 7 % 13 AS x", "id * 2 AS y")
    x, y = creation.from_dataframe(table, ["id"], ["x", "y"], (1000,), check=False)
    plan = lambda a: a.df._jdf.queryExecution().executedPlan().toString()
    assert shuffles(indexing.assigned(x, slice(2, None, 3), 5).df) == shuffles(indexing.assigned(x, y > 4, 5).df) == shuffles((x * y - 3).df) == 0
    monkeypatch.setattr(reduction, "SCAN_BLOCK", 16)
    monkeypatch.setattr(sorting, "WINDOW_CELLS", 16)
    for scan in (reduction.cumsum(x), reduction.cumsum(x, axis=0), reduction.cumprod(x), reduction.cumprod(x.astype(float))):
        assert "SinglePartition" not in plan(scan)
    joined = plan(linalg.vdot(x, y, lazy=True))
    assert "Join" not in joined
    assert "SortMergeJoin" not in plan(x[x > 4]) and plan(x[x > 4]).count("SinglePartition") == 0


def test_products_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(linalg, "TILE", 4)
    monkeypatch.setattr(linalg, "JOINED_PRODUCTS", 0)
    x, y = np.arange(2 * 6 * 5).reshape(2, 6, 5) * (1 << 58), np.arange(5 * 9).reshape(5, 9) - 7
    a, b = creation.array(spark, x.tolist()), creation.array(spark, y.tolist())
    with np.errstate(all="ignore"):
        same(a @ b, x @ y)
    same(creation.array(spark, (y / 8).tolist()) @ creation.array(spark, (y.T * 1j).tolist()), (y / 8) @ (y.T * 1j))


def test_views_share_their_base(spark):
    table = spark.range(24).selectExpr("id", "id * 7 % 13 AS x", "id * 2 AS y")
    x, y = creation.from_dataframe(table, ["id"], ["x", "y"], (24,), check=False)
    a, b = x.reshape(2, 3, 4).T, (y + 1).reshape(2, 3, 4).T
    assert a.base is b.base and shuffles((a * b).df) == 0
    p, q = np.arange(24) * 7 % 13, np.arange(24) * 2 + 1
    same(a * b, p.reshape(2, 3, 4).T * q.reshape(2, 3, 4).T)
    same(linalg.vdot(x.reshape(4, 6), y.reshape(4, 6)), (p * (q - 1)).sum())
    same(creation.tril(creation.ones(spark, (3, 3))).T, np.tril(np.ones((3, 3))).T)
    same(selection.where(a > 5, a, b)[1:, 0], np.where(p > 5, p, q).reshape(2, 3, 4).T[1:, 0])


def test_scalars_at_the_boundary(cube, spark):
    a, x = cube
    assert reduction.sum(a) == x.sum() and isinstance(reduction.sum(a), int) and reduction.max(a.astype(float)) == 23.0
    assert a[1, 2, 3] == x[1, 2, 3] and a[-1, 0, 0] == 12 and isinstance(reduction.all(a > 0), bool)
    assert linalg.trace(a[0]) == np.trace(x[0]) and reduction.argmax(a) == 23 and reduction.mean(a) == x.mean()
    v = a[0, 0]
    assert v @ v == linalg.dot(v, v) == 14 and linalg.vdot(v, v) == 14 and manipulation.squeeze(v[1:2]) == 1
    assert reduction.sum(a, lazy=True).shape == () and indexing.get(a, (0, 0, 1), lazy=True).item() == 1
    same(reduction.sum(a, axes=(0, 2)), x.sum(axis=(0, 2)))
    with pytest.raises(ShapeError):
        reduction.sum(a, axis=0, axes=(1,))
    assert creation.array(spark, 3, shape=(2, 2)).to_list() == [[3, 3], [3, 3]] and creation.array(spark, 1, float, shape=2).to_list() == [1.0, 1.0]
    assert list(a.flat) == list(range(24)) and list(v) == [0, 1, 2, 3] and [r.to_list() for r in a[0]] == x[0].tolist() and a.view().to_list() == x.tolist()
    assert len(iteration.ndindex((2, 3))) == 6 and list(iteration.ndindex(())) == [()]
    top = (1 << 63) - 1
    wrapped = creation.array(spark, [top]) + 1
    assert list(iteration.nditer((wrapped, creation.array(spark, [1])))) == [(-top - 1, 1)]


def test_text(spark):
    of = lambda v, **k: creation.array(spark, v, **k)
    for values_, kind, data, name in (
        ([True, False], bool, "True, False", "bool"), ([4, -7], int, "4, -7", "int64"), ([0.0, -0.0, NAN, -float("inf"), 2.5], float, "0, -0, nan, -inf, 2.5", "float64"),
        ([1 - 2j, 3 + 0j, complex(NAN, 0)], complex, "1-2j, 3+0j, nan+0j", "complex128"),
    ):
        a = of(values_, dtype=kind)
        assert repr(a).splitlines() == [f"gridloom-array at 0x{id(a):x}", f"  @ data: [{data}]", f"  @ shape: [{len(values_)}]", "  @ ndim: 1", f"  @ size: {len(values_)}", f"  @ dtype: {name}"]
        assert str(a) == f"[0] {data.replace(',', '')}"
    grid = creation.arange(spark, 12).reshape(2, 2, 3)
    assert str(grid[1].T) == "     [,0] [,1]\n[0,]    6    9\n[1,]    7   10\n[2,]    8   11"
    assert str(grid) == "[0, ,]\n     [,0] [,1] [,2]\n[0,]    0    1    2\n[1,]    3    4    5\n\n[1, ,]\n     [,0] [,1] [,2]\n[0,]    6    7    8\n[1,]    9   10   11"
    assert [b.splitlines()[0] for b in str(creation.arange(spark, 72).reshape(3, 6, 2, 2)).split("\n\n")] == ["[0, 0, ,]", "[0, 1, ,]", "[0, 2, ,]", "...", "[2, 3, ,]", "[2, 4, ,]", "[2, 5, ,]"]
    wide = creation.arange(spark, 900).reshape(30, 30)
    lines = str(wide).splitlines()
    assert lines[0].startswith("      [,0] [,1]") and " ... " in lines[0] and lines[4] == "..." and lines[-1].startswith("[29,]") and lines[-1].endswith("899")
    long = creation.arange(spark, 5000)
    assert "..." in repr(long) and repr(long).splitlines()[1].endswith("4999]") and str(long).startswith("[0] 0 1 2") and str(long).endswith(" 4999")
    huge = creation.full(spark, (9, 9), complex(1.7e308, -1.2345678901234567e-300))
    for a in (wide, long, huge, creation.ones(spark, (1,) * 64), creation.zeros(spark, (2, 0)), creation.zeros(spark, (0, 2)), creation.zeros(spark, (2, 0, 3)), creation.array(spark, [], int)):
        assert all(len(line) <= 80 for line in (repr(a) + "\n" + str(a)).splitlines())
    assert "  @ data: []" in repr(creation.zeros(spark, (2, 0)))


def test_sequences_and_scalars_as_operands(spark):
    a = creation.array(spark, [[1, 2], [3, 4]])
    same(ufunc.add(a, [10, 20]), np.array([[11, 22], [13, 24]]))
    same([[2, 0], [1, 1]] * a, np.array([[2, 0], [3, 4]]))
    same(ufunc.less([1, 5], (2, 2)), [True, False])
    assert ufunc.add(2, 3) == 5 and ufunc.multiply(2.0, 3j) == 6j and ufunc.equal(1, 1.0) is True and ufunc.absolute(3 - 4j) == 5.0 and ufunc.logical_not(0) is True
    assert ufunc.isnan(NAN) is True and ufunc.divide(-7, 2) == -3 and ufunc.conj(1 + 2j) == 1 - 2j


# What each refused call raises, with a part of its message.
REFUSED = {
    TypeError: {
        "dtype": lambda c, s: c.zeros(s, (2,), dtype=str), "expected nested list/tuple": lambda c, s: c.array(s, object()), "unsupported element type": lambda c, s: c.array(s, ["12"]),
        "where condition must be a bool array": lambda c, s: selection.where(c.array(s, [1, 0]), 1, 0), "index must be int, slice, ellipsis, None, or array": lambda c, s: c.array(s, [1, 2])[0.5],
        "fancy index must be an integer or boolean array": lambda c, s: c.array(s, [1, 2])[c.array(s, [1.0])], "axis must be an integer": lambda c, s: reduction.argmin(c.ones(s, 2), axis=0.5),
        "concatenate argument must be a sequence of arrays": lambda c, s: manipulation.concatenate(3), "nditer must be an array": lambda c, s: iteration.nditer((3,)),
        "modular array power is not supported": lambda c, s: pow(c.array(s, [4]), 2, 3),
    },
    ValueError: {
        "maximum depth": lambda c, s: c.array(s, __import__("functools").reduce(lambda x, _: [x], range(70), 1)), "0-dimensional arrays cannot be created": lambda c, s: c.array(s, 2),
        "shape dimensions must be non-negative": lambda c, s: c.zeros(s, (3, -2)), "shape size overflows": lambda c, s: c.zeros(s, (2**61, 16)), "inhomogeneous nested sequence": lambda c, s: c.array(s, [[1, 2], [3]]),
        "arange step must not be zero": lambda c, s: c.arange(s, 1, 4, 0), "linspace bounds must be finite": lambda c, s: c.linspace(s, 0.0, float("inf"), 4),
        "logspace base must be finite and greater than zero": lambda c, s: c.logspace(s, 0, 2, 3, base=-1.0), "geomspace bounds must have the same sign": lambda c, s: c.geomspace(s, 2.0, -2.0, 3),
        "only one reshape dimension may be -1": lambda c, s: c.arange(s, 6).reshape((-1, -1)), "cannot reshape array of size 6": lambda c, s: c.arange(s, 6).reshape((4,)),
        "cannot squeeze axis 1 with length 3": lambda c, s: c.ones(s, (1, 3)).squeeze(1), "axes must be a permutation": lambda c, s: c.ones(s, (2, 3)).permute_axes((1, 1)),
        "cannot specify both axis and axes": lambda c, s: reduction.mean(c.ones(s, 3), axis=0, axes=(0,)), "axes must not contain duplicates": lambda c, s: reduction.prod(c.ones(s, (2, 2)), axes=(1, -1)),
        "max of empty array / empty axis": lambda c, s: reduction.max(c.zeros(s, (0,))), "argmin of all-NaN slice": lambda c, s: reduction.argmin(c.array(s, [NAN]), nan_policy="ignore"),
        "nan_policy must be 'propagate' or 'ignore'": lambda c, s: reduction.std(c.ones(s, 3), nan_policy="drop"), "concatenate requires at least one array": lambda c, s: manipulation.concatenate([]),
        "all arrays must have the same shape": lambda c, s: manipulation.stack((c.ones(s, 3), c.ones(s, (1, 3)))), "operands could not be broadcast together": lambda c, s: c.ones(s, 3) + c.ones(s, 4),
        "clip bounds must be scalar values": lambda c, s: selection.clip(c.arange(s, 4), 1, c.array(s, [3])), "sort is not supported for dtype complex": lambda c, s: sorting.sort(c.array(s, [2j])),
        "ordering comparisons not supported for complex": lambda c, s: c.array(s, [2j]) < 1j, "nditer supports 1-2 operands": lambda c, s: iteration.nditer(()),
        "nditer requires operands with the same dtype": lambda c, s: iteration.nditer((c.array(s, [2]), c.array(s, [2.0]))), "matmul inner dimensions differ": lambda c, s: c.ones(s, (2, 3)) @ c.ones(s, (2, 3)),
        "dot supports only 1-D or 2-D operands": lambda c, s: linalg.dot(c.ones(s, (1, 1, 2)), c.ones(s, 2)), "vdot requires equal flattened sizes": lambda c, s: linalg.vdot(c.ones(s, 3), c.ones(s, 4)),
        "axis1 and axis2 must be different": lambda c, s: linalg.diagonal(c.ones(s, (2, 2)), axis1=1, axis2=1), "diag requires a 1-D or 2-D array": lambda c, s: c.diag(c.ones(s, (1, 2, 1))),
        "meshgrid inputs must be 1-D arrays": lambda c, s: c.meshgrid(c.ones(s, (2, 3))),
    },
    IndexError: {
        "axis 3 is out of bounds": lambda c, s: reduction.sum(c.ones(s, (2, 2)), axis=3), "out of bounds": lambda c, s: c.array(s, [1, 2])[-4], "single ellipsis": lambda c, s: c.ones(s, (2, 2))[..., 0, ...],
        "too many indices": lambda c, s: c.ones(s, (2, 2))[1, 1, 1], "boolean index shape": lambda c, s: c.ones(s, (2, 2))[c.array(s, [False, True, True])],
    },
    ZeroDivisionError: {"division by zero": lambda c, s: ufunc.remainder(c.array(s, [5]), c.array(s, [0])), "integer division by zero": lambda c, s: ufunc.divide(1, 0)},
}


@pytest.mark.parametrize("kind, part", [(kind, part) for kind, calls in REFUSED.items() for part in calls])
def test_refusals(spark, kind, part):
    with pytest.raises(kind) as found:
        REFUSED[kind][part](creation, spark)
    assert part in str(found.value)
