"""Typed errors; each is also the builtin that NumPy users expect."""


class ArrayError(Exception):
    pass


class ShapeError(ArrayError, ValueError):
    pass


class DTypeError(ArrayError, TypeError):
    pass


class UnsupportedError(ArrayError, ValueError):
    pass


class AxisError(ArrayError, IndexError):
    pass


class ArrayIndexError(ArrayError, IndexError):
    pass


class ReadOnlyError(ArrayError, ValueError):
    pass


class DivideByZeroError(ArrayError, ZeroDivisionError):
    pass
