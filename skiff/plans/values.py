"""Python functions as column expressions: they run once, on values that record what is done to them.

A function that needs a real value (``if x:``, ``len(x)``, a call into a library) cannot be recorded;
it runs as an Arrow UDF instead, and its return annotation gives the type. ``choose`` is the
conditional that works on recorded and on real values alike.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skiff.functions import collections as lists
from skiff.functions import numeric, text

KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "string": "str", "boolean": "bool"}
RETURNS = {int: "bigint", float: "double", bool: "boolean", str: "string", "int": "bigint", "float": "double", "bool": "boolean", "str": "string"}


class NotRecordable(TypeError):
    """The function needs a real value."""


def kind_of(spark_type: str) -> str:
    return KINDS.get(spark_type, "list" if spark_type.startswith("array") else "other")


class Value:
    """A column expression with the kind of Python value it stands for."""

    __hash__ = None

    def __init__(self, col: Column, kind: str):
        self.col, self.kind = col, kind

    def __bool__(self):
        raise NotRecordable("a recorded value has no truth; use choose()")

    __len__ = __iter__ = __index__ = __int__ = __float__ = __contains__ = __bool__

    def _with(self, other: Any, op: Callable, kind: str | None = None, swap: bool = False) -> Value:
        o = other if isinstance(other, Value) else constant(other)
        a, b = (o, self) if swap else (self, o)
        return Value(op(a.col, b.col), kind or ("float" if "float" in (a.kind, b.kind) else a.kind))

    def __add__(self, o):
        return self._with(o, F.concat if self.kind in ("str", "list") else lambda a, b: a + b)

    def __radd__(self, o):
        return self._with(o, F.concat if self.kind in ("str", "list") else lambda a, b: a + b, swap=True)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._with(o, lambda a, b: a - b, swap=True)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._with(o, numeric.float_div, "float")

    def __rtruediv__(self, o):
        return self._with(o, numeric.float_div, "float", swap=True)

    def __floordiv__(self, o):
        return self._with(o, numeric.int_div, "int")

    def __mod__(self, o):
        return self._with(o, lambda a, b: a % b)

    def __pow__(self, o):
        return Value(numeric.power(self.col, o.col if isinstance(o, Value) else o), self.kind)

    def __neg__(self):
        return Value(-self.col, self.kind)

    def __abs__(self):
        return Value(F.abs(self.col), self.kind)

    def __round__(self, n=0):
        return Value(F.bround(self.col, n), self.kind)

    def _compare(self, o, op):
        return self._with(o, op, "bool")

    def __eq__(self, o):
        return self._compare(o, lambda a, b: a == b)

    def __ne__(self, o):
        return self._compare(o, lambda a, b: a != b)

    def __lt__(self, o):
        return self._compare(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._compare(o, lambda a, b: a <= b)

    def __gt__(self, o):
        return self._compare(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._compare(o, lambda a, b: a >= b)

    def __and__(self, o):
        return self._compare(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._compare(o, lambda a, b: a | b)

    def __invert__(self):
        return Value(~self.col, "bool")

    def __getitem__(self, key):
        if isinstance(key, slice):
            cut = text.slice_ if self.kind == "str" else lambda c, a, b, s: lists.cut(c, a or 0, b, s or 1)
            return Value(cut(self.col, key.start, key.stop, key.step), self.kind)
        if self.kind == "str":
            return Value(text.slice_(self.col, key, key + 1 or None), "str")
        return Value(lists.item(self.col, key), "other")

    def __getattr__(self, name: str):
        make = _METHODS.get(name)
        if make is None or self.kind != "str":
            raise NotRecordable(f"no recorded {name}() for {self.kind}")
        fn, kind = make
        return lambda *args: Value(fn(self.col, *args), kind)


_METHODS = {
    "lower": (F.lower, "str"), "upper": (F.upper, "str"), "strip": (text.strip, "str"), "rstrip": (text.rstrip, "str"),
    "find": (text.find, "int"), "rfind": (text.rfind, "int"), "replace": (text.replace, "str"), "split": (text.split, "list"),
    "partition": (text.partition, "other"), "rpartition": (text.rpartition, "other"), "isdigit": (text.isdigit, "bool"),
    "isascii": (text.isascii, "bool"), "contains": (text.contains, "bool"), "length": (F.char_length, "int"),
    "startswith": (lambda c, p: F.startswith(c, F.lit(p)), "bool"), "endswith": (lambda c, p: F.endswith(c, F.lit(p)), "bool"),
    "to_int": (numeric.to_int, "int"), "to_float": (lambda c: c.try_cast("double"), "float"),
}


class Row:
    """A row whose fields are recorded values."""

    def __init__(self, kinds: dict[str, str]):
        self._kinds = kinds

    def __getitem__(self, name: str) -> Value:
        if name not in self._kinds:
            raise KeyError(name)
        return Value(F.col(f"`{name}`"), self._kinds[name])

    def __getattr__(self, name: str) -> Value:
        return self[name]


def constant(v: Any) -> Value:
    kind = {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), "other")
    return Value(F.lit(v), kind)


def choose(test: Any, yes: Any, no: Any) -> Any:
    """yes if test else no."""
    if not isinstance(test, Value):
        return yes if test else no
    y, n = (v if isinstance(v, Value) else constant(v) for v in (yes, no))
    return Value(F.when(test.col, y.col).otherwise(n.col), y.kind)


def sqrt(x: Any) -> Any:
    import math

    return Value(F.sqrt(x.col), "float") if isinstance(x, Value) else math.sqrt(x)


def recorded(fn: Callable, *args: Any) -> Value | None:
    """What ``fn`` does to recorded values; None if it needs real ones."""
    try:
        out = fn(*args)
    except (NotRecordable, TypeError):
        return None
    return out if isinstance(out, Value) else constant(out)


def return_type(fn: Callable) -> str:
    note = inspect.signature(fn).return_annotation
    if note not in RETURNS:
        raise TypeError("a function that cannot be recorded needs a return annotation: int, float, bool or str")
    return RETURNS[note]


def compile_scalar(fn: Callable, args: list[Value], strict: bool = False) -> Column:
    """``fn`` over columns: an expression if it can be recorded, else an Arrow UDF."""
    out = recorded(fn, *args)
    if out is not None:
        return out.col
    if strict:
        raise NotRecordable(f"{getattr(fn, '__name__', fn)} cannot be recorded")

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*v) for v in zip(*series)])

    return F.pandas_udf(_batches(run, len(args)), return_type(fn))(*[a.col for a in args])


def _batches(run: Callable, n: int) -> Callable:
    if n == 1:
        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return one

    def many(*a: pd.Series) -> pd.Series:
        return run(*a)

    return many


def compile_row(fn: Callable, kinds: dict[str, str], strict: bool = False) -> Column:
    """``fn`` over a row; the fallback passes each row as a dict."""
    out = recorded(fn, Row(kinds))
    if out is not None:
        return out.col
    if strict:
        raise NotRecordable("the row function cannot be recorded")

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([fn(r) for r in rows.to_dict("records")])

    return F.pandas_udf(run, return_type(fn))(F.struct(*[f"`{c}`" for c in kinds]))
