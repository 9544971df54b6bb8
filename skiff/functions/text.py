"""Strings with Python's semantics, as Columns. Lengths and places count characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that strip removes.
BLANKS = " \t\n\r\f\x0b"


def _place(i: int | None, n: Column, default: Column) -> Column:
    if i is None:
        return default
    return F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))


def slice_(c: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    n = F.char_length(c)
    a, b = _place(start, n, F.lit(0)), _place(stop, n, n)
    if step in (None, 1):
        return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))
    if step < 1:
        raise ValueError("the step of a slice must be positive")
    letters = F.split(slice_(c, start, stop), "")
    return F.array_join(F.filter(letters, lambda x, i: i % step == 0), "")


def at(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1)


def find(c: Column, sub: str, start: int = 0) -> Column:
    return F.locate(sub, c, start + 1) - 1


def rfind(c: Column, sub: str) -> Column:
    back = F.char_length(c) - len(sub) - F.instr(F.reverse(c), sub[::-1]) + 1
    return F.when(F.contains(c, F.lit(sub)), back).otherwise(-1)


def contains(c: Column, sub: str | Column) -> Column:
    return F.contains(c, F.lit(sub))


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def split(c: Column, sep: str, maxsplit: int = -1) -> Column:
    return F.split(c, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", maxsplit + 1 if maxsplit >= 0 else -1)


def join(items: Column, sep: str) -> Column:
    return F.array_join(items, sep)


def partition(c: Column, sep: str) -> Column:
    """(before, sep, after) at the first separator; (text, '', '') without one."""
    i = find(c, sep)
    return F.struct(
        F.when(i >= 0, F.substring(c, F.lit(1), i)).otherwise(c).alias("head"),
        F.when(i >= 0, sep).otherwise("").alias("sep"),
        F.when(i >= 0, F.substring(c, i + 1 + len(sep), F.char_length(c))).otherwise("").alias("tail"),
    )


def rpartition(c: Column, sep: str) -> Column:
    """(before, sep, after) at the last separator; ('', '', text) without one."""
    i = rfind(c, sep)
    return F.struct(
        F.when(i >= 0, F.substring(c, F.lit(1), i)).otherwise("").alias("head"),
        F.when(i >= 0, sep).otherwise("").alias("sep"),
        F.when(i >= 0, F.substring(c, i + 1 + len(sep), F.char_length(c))).otherwise(c).alias("tail"),
    )


def letters(c: Column) -> Column:
    """The characters as an array."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def isdigit(c: Column) -> Column:
    """Whether the first character is a digit."""
    return c.rlike("^[0-9]")


def isascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def code(c: Column) -> Column:
    """Code point of the first character."""
    return F.ascii(c)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


lower, upper, length, concat, levenshtein = F.lower, F.upper, F.char_length, F.concat, F.levenshtein


def bytes_slice(c: Column, start: int, stop: int) -> Column:
    return F.substring(c.cast("binary"), start + 1, max(0, stop - start))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z folded and no other letter, as the compiled original does; ``lower`` folds all of Unicode."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)
