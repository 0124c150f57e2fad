"""Shapes, axes and strides: plain numbers on the driver, checked before any plan is built."""

from __future__ import annotations

from math import prod

from gridloom.errors import AxisError, DTypeError, ShapeError

LARGEST = (1 << 63) - 1


def checked_shape(shape) -> tuple[int, ...]:
    dims = (shape,) if isinstance(shape, int) and not isinstance(shape, bool) else tuple(shape)
    if any(isinstance(d, bool) or not isinstance(d, int) for d in dims):
        raise TypeError("shape dimensions must be integers")
    if any(d < 0 for d in dims):
        raise ShapeError("shape dimensions must be non-negative")
    if prod(d for d in dims if d) > LARGEST:
        raise ShapeError("shape size overflows")
    return dims


def strides(shape) -> tuple[int, ...]:
    """C-order steps of the linear index."""
    return tuple(prod(shape[k + 1 :]) for k in range(len(shape)))


def normal_axis(axis: int, ndim: int) -> int:
    if isinstance(axis, bool) or not isinstance(axis, int):
        raise DTypeError("axis must be an integer")
    if not -ndim <= axis < ndim:
        raise AxisError(f"axis {axis} is out of bounds for array of dimension {ndim}")
    return axis % ndim


def normal_axes(axis, ndim: int) -> tuple[int, ...]:
    """All axes for None; else those named, each once."""
    if axis is None:
        return tuple(range(ndim))
    named = tuple(axis) if isinstance(axis, (list, tuple)) else (axis,)
    if not named:
        raise ShapeError("axes must not be empty")
    found = tuple(normal_axis(a, ndim) for a in named)
    if len(set(found)) < len(found):
        raise ShapeError("axes must not contain duplicates")
    return tuple(sorted(found))


def broadcast(*shapes) -> tuple[int, ...]:
    """Trailing axes are aligned; lengths agree or are 1."""
    ndim = max((len(s) for s in shapes), default=0)
    result = []
    for k in range(-ndim, 0):
        lengths = {s[k] for s in shapes if len(s) >= -k} - {1}
        if len(lengths) > 1:
            raise ShapeError(f"operands could not be broadcast together: {shapes}")
        result.append(lengths.pop() if lengths else 1)
    return tuple(result)


def reshaped(shape, new) -> tuple[int, ...]:
    size, dims = prod(shape), [new] if isinstance(new, int) else list(new)
    if dims.count(-1) > 1:
        raise ShapeError("only one reshape dimension may be -1")
    if -1 in dims:
        rest = prod(d for d in dims if d != -1)
        if not rest or size % rest:
            raise ShapeError(f"cannot reshape array of size {size} into shape {tuple(dims)}")
        dims[dims.index(-1)] = size // rest
    dims = checked_shape(dims)
    if prod(dims) != size:
        raise ShapeError(f"cannot reshape array of size {size} into shape {dims}")
    return dims
