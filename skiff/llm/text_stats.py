"""Counts over whole texts that quality rules and classifiers use, one vectorised scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skiff.llm.common import arrow_map
from skiff.llm.textkit import _SPACE, Words, mix, powers, slices, utf8
from skiff.llm.textkit import _BYTE as BYTE

#: The counts, all long.
COUNTS = (
    "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_same_next", "n_upper", "n_lower", "n_digits", "n_wide", "n_bangs", "n_pipes", "n_stops", "n_stop_lines",
)


def _members(text: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text)] = True
    return table


_SYMBOL, _UPPER, _LOWER = _members(b"#*$%&|<>"), _members(bytes(range(65, 91))), _members(bytes(range(97, 123)))
_DIGIT, _BANG, _PIPE, _STOP = _members(b"0123456789"), _members(b"!"), _members(b"|"), _members(b".!?:;\"')")


def stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a slice."""
    docs = len(offsets) - 1

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    space = _SPACE[data]
    lead = (data & 0xC0) != 0x80
    words = Words(data, offsets)
    h = words.hashes()
    out = {
        "n_bytes": np.diff(offsets),
        "n_words": words.count,
        "word_chars": per_doc(lead & ~space),
        "n_symbols": per_doc(_SYMBOL[data]),
        "n_upper": per_doc(_UPPER[data]),
        "n_lower": per_doc(_LOWER[data]),
        "n_digits": per_doc(_DIGIT[data]),
        "n_wide": per_doc(data >= 0xC0),
        "n_bangs": per_doc(_BANG[data]),
        "n_pipes": per_doc(_PIPE[data]),
        "n_stops": per_doc(data == ord(".")),
    }
    same = np.zeros(len(h), np.int64)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["n_same_next"] = np.bincount(words.doc, same, docs).astype(np.int64)

    # Lines: what \n and the ends of documents bound.
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(cut + 1, offsets[:-1])
    begin = begin[begin < len(data)] if len(data) else begin[:0]
    stop = np.append(begin[1:], len(data))
    doc = np.searchsorted(offsets, begin, "right") - 1
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    has = filled[stop] > filled[begin] if len(begin) else np.zeros(0, bool)
    begin, stop, doc = begin[has], stop[has], doc[has]
    # Without the closing \n, so that a document's last line equals one before it.
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    out["n_lines"] = np.bincount(doc, minlength=docs)
    out["n_stop_lines"] = np.bincount(doc, _STOP[data[stop - 1]] if len(stop) else None, docs).astype(np.int64)
    if len(begin):
        length = stop - begin
        first = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(first, length)
        value = BYTE[data[inside + np.repeat(begin, length)]] * powers(int(length.max()))[inside]
        key = mix(np.add.reduceat(value, first) + length.astype(np.uint64)) ^ mix(doc.astype(np.uint64) + np.uint64(1))
        _, once = np.unique(key, return_index=True)
        out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[once], minlength=docs)
    else:
        out["n_dup_lines"] = np.zeros(docs, np.int64)

    # Words inside three-word windows that the document has twice or more.
    repeat = np.zeros(docs, np.int64)
    if len(h) >= 3:
        inner = words.doc[2:] == words.doc[:-2]
        at = np.flatnonzero(inner)
        key = mix(h[at] + mix(h[at + 1] + mix(h[at + 2]))) ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        hit = at[order[twin]]
        covered = np.zeros(len(h), bool)
        for j in range(3):
            covered[hit + j] = True
        repeat = np.bincount(words.doc, covered, docs).astype(np.int64)
    out["n_repeat_words"] = repeat
    return out


def with_stats(docs: DataFrame, *keep: str, text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``text`` also the text as ``_text``, and its counts; a null text counts as empty."""
    names = [*keep, *["_text"] * text]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(len(keep)))
        found = []
        for i, j in slices(offsets):
            at = offsets[i : j + 1]
            found.append(stats(data[at[0] : at[-1]], at - at[0]))
        cols = [pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], [*names, *COUNTS])

    some = docs.select(*keep, F.col("text").alias("_text"))
    return arrow_map(some, rows, StructType([*some.schema.fields[: len(names)], *(StructField(c, LongType()) for c in COUNTS)]))
