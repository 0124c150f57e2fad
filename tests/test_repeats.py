"""Arrays that repeat others, against NumPy: values, plans without cells, and the read-only flag."""

import numpy as np
import pytest

from gridloom.errors import ReadOnlyError, ShapeError
from gridloom.operators import indexing, linalg, manipulation, reduction, selection, sorting, ufunc
from gridloom.sources import creation
from tests.test_arrays import same


def plan(a):
    return a.df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    """(a, x): a broadcast view with two repeated axes, and NumPy's."""
    x = np.arange(6).reshape(2, 1, 3) * 7 % 5
    return manipulation.broadcast_to(creation.array(spark, x.tolist()), (4, 2, 5, 3)), np.broadcast_to(x, (4, 2, 5, 3))


def test_views_compose(wide):
    a, x = wide
    assert a.repeats and a.read_only
    views = {
        "self": (a, x), "permute": (a.permute_axes((2, 3, 0, 1)), x.transpose(2, 3, 0, 1)), "T": (a.T, x.T), "slices": (a[1:4:2, ::-1, None, 3, 1:], x[1:4:2, ::-1, None, 3, 1:]),
        "integers": (a[2, 1, 4], x[2, 1, 4]), "ellipsis": (a[..., 0], x[..., 0]), "split": (a.reshape(2, 2, 2, 5, 3, 1), x.reshape(2, 2, 2, 5, 3, 1)), "squeeze": (a[:1].squeeze(), x[0]),
        "backwards": (a[::-2, :, 4:0:-3], x[::-2, :, 4:0:-3]), "again": (manipulation.broadcast_to(a[:1, :, :1], (3, 2, 6, 3)), np.broadcast_to(x[:1, :, :1], (3, 2, 6, 3))),
        "more": (manipulation.broadcast_to(a, (2, 4, 2, 5, 3)), np.broadcast_to(x, (2, 4, 2, 5, 3))),
    }
    for name, (b, want) in views.items():
        assert b.repeats or name == "integers", name
        assert b.read_only, name
        same(b, want)
    assert a[3, 1, 4, 2] == x[3, 1, 4, 2] and a[:1, :1, :1, :1].item() == x[0, 0, 0, 0]
    same(a.reshape(-1), x.reshape(-1))  # takes repeated and other axes together: a copy
    assert not a.reshape(-1).read_only


def test_operations_on_what_repeats(wide, spark):
    a, x = wide
    rows = creation.arange(spark, 5).reshape(5, 1)
    y = np.arange(5).reshape(5, 1)
    for b, want in (
        (a + 1, x + 1), (-a, -x), (a.astype(float) / 2, x / 2), (a * a, x * x), (selection.clip(a, 1, 3), x.clip(1, 3)), (selection.where(a > 2, a, 0), np.where(x > 2, x, 0)),
        (ufunc.logical_not(a), ~(x != 0)), (a.T + a.T, x.T + x.T), (ufunc.complex_of(a, a), x + 1j * x),
    ):
        assert b.repeats and not b.read_only
        same(b, want)
    same(a + rows, x + y)  # repeated along the first axis still
    assert (a + rows).repeats and not (a + creation.zeros(spark, (4, 2, 5, 3), int)).repeats
    for name in ("sum", "min", "max", "mean", "std", "any", "all", "prod", "argmin", "argmax"):
        for axis in (None, 2) if name in ("sum", "any", "prod", "argmin") else (0,):
            same(getattr(reduction, name)(a, axis=axis), getattr(np, name)(x, axis=axis))
    same(reduction.sum(a, axis=(0, 3), keepdims=True), x.sum(axis=(0, 3), keepdims=True))
    assert reduction.sum(a, axis=1, lazy=True).repeats
    huge = manipulation.broadcast_to(creation.array(spark, [3, -5]), (1 << 61, 2))
    assert reduction.sum(huge, axis=0).to_list() == [3 << 61, 3 << 61] and huge[1 << 60, 1] == -5  # -5 << 61 wraps to the same
    same(reduction.cumsum(a, axis=2), x.cumsum(axis=2))
    same(sorting.sort(a, axis=1), np.sort(x, axis=1))
    same(a[a > 2], x[x > 2])
    same(a[creation.array(spark, [3, 0])], x[[3, 0]])
    same(linalg.diagonal(a, axis1=2, axis2=3), np.diagonal(x, axis1=2, axis2=3))
    same(a @ creation.ones(spark, (3, 2), int), x @ np.ones((3, 2), int))
    same(manipulation.concatenate([a, a.copy()], 1), np.concatenate([x, x], 1))
    zero = manipulation.broadcast_to(creation.arange(spark, 3), (0, 3))
    assert zero.to_list() == [] and zero.shape == (0, 3) and zero.read_only


def test_no_cells_until_asked_for(spark):
    n = 10**7
    x, y = creation.meshgrid(creation.arange(spark, n), creation.arange(spark, n))
    assert x.shape == y.shape == (n, n)  # 10^14 cells
    total = reduction.sum(x % 10, axis=0)
    assert "Join" not in plan(total)
    assert x[17, 23] == 23 and y[17, 23] == 17 and (x + y)[n - 1, n - 1] == 2 * n - 2
    part = (x[:3, ::5_000_000] + y[:3, ::5_000_000]).to_list()
    assert part == [[0, 5_000_000], [1, 5_000_001], [2, 5_000_002]]
    assert reduction.max(manipulation.broadcast_to(creation.arange(spark, 9), (n, n, 9))) == 8


def test_read_only(spark):
    source = creation.arange(spark, 3)
    x, y = creation.meshgrid(source, creation.arange(spark, 2))
    alone = creation.meshgrid(source)[0]
    for a in (x, y, alone, x.T, x[0], x[:, None], x.view(), x.reshape(2, 1, 3), manipulation.broadcast_to(source, (3,)), *manipulation.broadcast_arrays([source.reshape(3, 1), source]), linalg.diagonal(x)):
        for key in (0, Ellipsis):
            with pytest.raises(ReadOnlyError, match="read-only"):
                a[key] = 9
        with pytest.raises(ValueError):
            a[creation.array(spark, [0])] = 1
    for a in (x.copy(), x + 0, x.astype(float), x[creation.array(spark, [0, 1])], x[x >= 0], x.T.copy(), source.T, source[:2]):
        a[0] = 7
        assert 7 in np.array(a.to_list()).ravel() and source.to_list() == [0, 1, 2] and x.to_list() == [[0, 1, 2]] * 2
    changed = indexing.assigned(creation.zeros(spark, (4, 2, 3), int), slice(1, 3), x)  # a value that repeats
    want = np.zeros((4, 2, 3), int)
    want[1:3] = np.broadcast_to(np.arange(3), (2, 3))
    same(changed, want)


def test_broadcast_shapes_and_arrays(spark):
    assert manipulation.broadcast_shapes() == () and manipulation.broadcast_shapes((3, 1), (4,), (2, 1, 1)) == (2, 3, 4)
    assert manipulation.broadcast_arrays([]) == []
    with pytest.raises(ShapeError, match="broadcast"):
        manipulation.broadcast_shapes((2,), (3,))
    with pytest.raises(ShapeError, match="broadcast"):
        manipulation.broadcast_arrays([creation.arange(spark, 2), creation.arange(spark, 3)])
    with pytest.raises(ShapeError, match="broadcast"):
        manipulation.broadcast_to(creation.arange(spark, 3), (3, 2))
    a, b = manipulation.broadcast_arrays([creation.arange(spark, 2).reshape(2, 1), creation.arange(spark, 3)])
    same(a, [[0] * 3, [1] * 3])
    same(b, [[0, 1, 2]] * 2)
