"""Lists, dicts and tuples as arrays, maps and structs; dense 1-D arrays as array cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def append(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def repeat(a: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def item(a: Column, i: int) -> Column:
    """The i-th item, from the end for negative i; NULL outside."""
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def put(a: Column, i: int, v: Column) -> Column:
    """The array with its i-th item replaced."""
    return F.transform(a, lambda x, k: F.when(k == i, v).otherwise(x))


def cut(a: Column, start: int = 0, stop: int | None = None, step: int = 1) -> Column:
    n = F.size(a)
    lo = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    part = F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))
    return part if step == 1 else F.filter(part, lambda x, i: i % step == 0)


def comprehension(a: Column, value: Callable, keep: Callable | None = None) -> Column:
    """[value(x) for x in a if keep(x)]"""
    return F.transform(F.filter(a, keep) if keep else a, value)


def fold(a: Column, start: Column, step: Callable) -> Column:
    return F.aggregate(a, start, step)


def total(a: Column) -> Column:
    """Sum of a list, 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def get_or(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def with_entry(m: Column, key: Column, value: Column) -> Column:
    """The map with an entry added or replaced."""
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value))


def in_order(a: Column, reverse: bool = False) -> Column:
    """A sorted list; nulls last, or first in reverse."""
    return F.reverse(F.array_sort(a)) if reverse else F.array_sort(a)


def keys(m: Column) -> Column:
    return F.map_keys(m)


def items(m: Column) -> Column:
    """The (key, value) pairs of a dict, to go through with ``comprehension`` or ``fold``."""
    return F.map_entries(m)


def enumerated(a: Column, start: int = 0) -> Column:
    """Pairs (i, v) of places and items."""
    return F.transform(a, lambda v, i: F.struct((i + start).alias("i"), v.alias("v")))


def elementwise(a: Column, b: Column | float, op: Callable) -> Column:
    """op on arrays of equal length, or on an array and a scalar."""
    if isinstance(b, Column):
        return F.zip_with(a, b, op)
    return F.transform(a, lambda x: op(x, F.lit(b)))


def reshape(a: Column, rows: int, cols: int) -> Column:
    """A flat array as ``rows`` arrays of ``cols``."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * cols + 1, cols))


def less(a: Column, b: Column) -> Column:
    """a < b of lists, as the compiled original has it: in the places that both have, some item is less and none is greater."""
    pairs = F.arrays_zip(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))).alias("x"), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))).alias("y"))
    return F.exists(pairs, lambda p: p["x"] < p["y"]) & ~F.exists(pairs, lambda p: p["x"] > p["y"])


def list_text(a: Column, item: Callable[[Column], Column]) -> Column:
    """A list as Python shows it, with ``item`` for the text of an item."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, item), ", "), F.lit("]"))


def dict_text(m: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """A dict as Python shows it."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(key(e["key"]), F.lit(": "), value(e["value"]))), ", "), F.lit("}"))


def quoted(s: Column) -> Column:
    """A text as Python shows it, without escapes but those of the quote and the backslash."""
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def rectangular(a: Column) -> Column:
    """A list of lists as a 2-D array: an error where their lengths differ."""
    same = F.forall(a, lambda x: F.size(x) == F.size(a[0]))
    return F.when(same, a).otherwise(F.raise_error(F.lit("lists of different lengths are no array")))


def filled(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def try_or(value: Column, default) -> Column:
    """The value, or the default where computing it gave NULL."""
    return F.coalesce(value, F.lit(default))
