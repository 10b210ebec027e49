"""One formula, three engines.

A closed-form function is written once over a namespace ``m``: Spark Columns
(``COLUMNS``), SQL text for another engine to check it by (``TEXT``) or numpy
arrays inside a task (``ARRAYS``).  Arithmetic and comparison are the operands' own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Text:
    """A piece of SQL with Python's operators."""

    def __init__(self, sql: object) -> None:
        self.sql = f"{float(sql):.17e}" if isinstance(sql, int | float) else str(sql)

    def __str__(self) -> str:
        return self.sql


def _operator(symbol: str, swapped: bool = False):
    def apply(self: Text, other: object) -> Text:
        a, b = (Text(str(other) if isinstance(other, Text) else other), self) if swapped else (self, Text(str(other) if isinstance(other, Text) else other))
        return Text(f"({a} {symbol} {b})")

    return apply


for _name, _symbol in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/")):
    setattr(Text, f"__{_name}__", _operator(_symbol))
    setattr(Text, f"__r{_name}__", _operator(_symbol, True))
for _name, _symbol in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>"), ("and", "AND"), ("or", "OR")):
    setattr(Text, f"__{_name}__", _operator(_symbol))
Text.__neg__ = lambda self: Text(f"(-{self})")
Text.__hash__ = None


class Columns:
    """Spark."""

    @staticmethod
    def lift(x: object) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    exp, log, sqrt, abs = staticmethod(F.exp), staticmethod(F.log), staticmethod(F.sqrt), staticmethod(F.abs)
    sin, cos, asin, tanh = staticmethod(F.sin), staticmethod(F.cos), staticmethod(F.asin), staticmethod(F.tanh)

    @classmethod
    def where(cls, test: Column, yes: object, no: object) -> Column:
        return F.when(test, cls.lift(yes)).otherwise(cls.lift(no))

    @classmethod
    def either(cls, test: Column, yes: Callable, no: Callable, x: Column) -> Column:
        """yes(x) where the test holds, else no(x); of arrays, the second meets the entries that need it only."""
        return cls.where(test, yes(x), no(x))

    @classmethod
    def greatest(cls, *xs: object) -> Column:
        return F.greatest(*map(cls.lift, xs)) if len(xs) > 1 else cls.lift(xs[0])

    @classmethod
    def least(cls, *xs: object) -> Column:
        return F.least(*map(cls.lift, xs)) if len(xs) > 1 else cls.lift(xs[0])


class _TextNames(type):
    def __getattr__(cls, name: str):
        if name in ("exp", "sqrt", "abs", "sin", "cos", "asin", "tanh", "log"):
            return lambda x: Text(f"{'ln' if name == 'log' else name}({Text(str(x) if isinstance(x, Text) else x)})")
        raise AttributeError(name)


class Texts(metaclass=_TextNames):
    """SQL text."""

    @staticmethod
    def lift(x: object) -> Text:
        return x if isinstance(x, Text) else Text(x)

    @classmethod
    def where(cls, test: Text, yes: object, no: object) -> Text:
        return Text(f"(CASE WHEN {test} THEN {cls.lift(yes)} ELSE {cls.lift(no)} END)")

    @classmethod
    def either(cls, test: Text, yes: Callable, no: Callable, x: Text) -> Text:
        return cls.where(test, yes(x), no(x))

    @classmethod
    def greatest(cls, *xs: object) -> Text:
        return Text(f"greatest({', '.join(str(cls.lift(x)) for x in xs)})")

    @classmethod
    def least(cls, *xs: object) -> Text:
        return Text(f"least({', '.join(str(cls.lift(x)) for x in xs)})")


class Arrays:
    """numpy, inside a task."""

    exp, log, sqrt, abs = staticmethod(np.exp), staticmethod(np.log), staticmethod(np.sqrt), staticmethod(np.abs)
    sin, cos, asin, tanh, where = staticmethod(np.sin), staticmethod(np.cos), staticmethod(np.arcsin), staticmethod(np.tanh), staticmethod(np.where)

    @staticmethod
    def lift(x: object) -> np.ndarray:
        return np.asarray(x, float)

    @staticmethod
    def either(test: np.ndarray, yes: Callable, no: Callable, x: np.ndarray) -> np.ndarray:
        out = np.asarray(yes(x))  # a new array
        if not test.all():
            out[~test] = no(np.asarray(x)[~test])
        return out

    @staticmethod
    def greatest(*xs: object) -> np.ndarray:
        return reduce(np.maximum, xs)

    @staticmethod
    def least(*xs: object) -> np.ndarray:
        return reduce(np.minimum, xs)


COLUMNS, TEXT, ARRAYS = Columns, Texts, Arrays


def total(xs: list) -> object:
    """Sum from the first to the last, so that engines agree in the last bits."""
    return reduce(lambda a, b: a + b, xs)


def product(xs: list) -> object:
    return reduce(lambda a, b: a * b, xs)
