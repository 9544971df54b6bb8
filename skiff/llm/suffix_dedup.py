"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that starts elsewhere too.

1. Anchors. Of all grams of ``GRAM`` bytes inside a window of ``length`` bytes, the one of least hash (the
   leftmost of equals) is its anchor. Equal windows have equal anchors in equal places, so
   repeats show as anchors of one hash, about one row for 180 bytes of text.
2. Anchors whose hash is unique in the corpus drop out. The context of an anchor is the text of all
   its windows. Contexts that repeat as a whole need no comparison.
3. The suffixes (and reversed prefixes) at the anchors of one hash, a sparse suffix array of the distinct
   contexts, are sorted by deep-shallow sorting; common prefixes there tell which windows repeat.
   A hash with more than ``BLOCK`` contexts is sorted in blocks; what can repeat only across
   blocks is then counted by digests of windows.
4. The repeats of a document are joined to its text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from skiff.llm.common import arrow_map, map_batches, materialize
from skiff.llm.suffix_sort import repeats
from skiff.llm.textkit import _BYTE, U, mix, powers, utf8

GRAM = 32
#: Bytes of text whose anchors are found together.
SLICE = 1 << 20
#: Contexts of one anchor hash that one task sorts together.
BLOCK = 4096
_INVERSE = pow(int(powers(2)[1]), -1, 1 << 64)
_INVERSES = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        p = np.full(max(n, 2 * len(_INVERSES)), _INVERSE, np.uint64)
        p[0] = 1
        _INVERSES = np.multiply.accumulate(p)
    return _INVERSES[:n]


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every window of w values, by minima from both ends of blocks of w."""
    n = len(key)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, piece, pos, lo, hi) of the anchors of the pieces [begin, end) of data.

    The windows that start at lo..hi (places in data, as pos) have the anchor at pos.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    gram = min(GRAM, length)
    if len(data) < length:
        return none
    table = _BYTE[data] * powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table, out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * _inverses(len(data) - gram + 1))
    bits = U(max(1, int(len(h)).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    low = _least(((h >> bits) << bits) | place, length - gram + 1)
    pos = (low & ((U(1) << bits) - U(1))).astype(np.int64)  # by window start
    ok = np.zeros(len(data) + 1, np.int8)
    fits = end - begin >= length
    np.add.at(ok, begin[fits], 1)
    np.add.at(ok, end[fits] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[: len(pos)]) > 0)
    if not len(start):
        return none
    p = pos[start]
    piece = np.searchsorted(begin, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return h[p[first]].view(np.int64), piece[first], p[first], start[first], start[last]


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, document, begin, end): stretches of the data of about SLICE bytes, with the pieces in them.

    A document longer than that is dealt in pieces that overlap by length - 1 bytes, so every window is in one.
    """
    docs, begin, end, total = [], [], [], 0

    def flush():
        b, e = np.array(begin, np.int64), np.array(end, np.int64)
        return int(b[0]), int(e[-1]), np.array(docs), b - b[0], e - b[0]

    for d in range(len(offsets) - 1):
        a, z = int(offsets[d]), int(offsets[d + 1])
        for x in range(a, max(z, a + 1), SLICE):
            if x > a and z - x < length:
                break
            y = min(z, x + SLICE + length - 1)
            if docs and (total + y - x > SLICE or x > a):
                yield flush()
                docs, begin, end, total = [], [], [], 0
            docs.append(d)
            begin.append(x)
            end.append(y)
            total += y - x
    if docs:
        yield flush()


ANCHOR = "h long, c long, doc_id long, text_key long, pos long, left int, right int, copies int"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row for each anchor; c digests the context, left and right are its bytes about the anchor.

    Contexts that repeat inside the stretch of text at hand are found at once: they give one row
    with ``copies`` 2, and their places as rows with h null (left 0, right the length).
    """

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        raw, offsets = utf8(batch.column(2))
        for a, z, doc, begin, end in pieces(offsets, length):
            data = raw[a:z]
            h, piece, pos, lo, hi = anchors(data, begin, end, length)
            if not len(h):
                continue
            text, size = data.tobytes(), hi + length
            digest = hashlib.blake2b
            c = np.frombuffer(b"".join([digest(text[x:y], digest_size=8).digest() for x, y in zip(lo.tolist(), size.tolist())]), "<i8")
            order = np.lexsort((c, h))
            head = np.ones(len(h), bool)
            head[1:] = (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
            group = np.cumsum(head) - 1
            count = np.bincount(group)
            many = count[group] > 1
            first, copies = order[head], np.minimum(count, 2)
            again = np.sort(order[many])
            if len(again):  # joined where they overlap
                s, e, p = lo[again], size[again], piece[again]
                reach = np.maximum.accumulate(e)
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] > reach[:-1]) | (p[1:] != p[:-1])
                f = np.flatnonzero(new)
                l = np.append(f[1:], len(s)) - 1
                ms, me, mp = s[f], reach[l], p[f]
            else:
                ms = me = mp = np.zeros(0, np.int64)
            at = np.concatenate([piece[first], mp])
            base = a + np.zeros(len(at), np.int64) - offsets[doc[at]]
            nulls = np.concatenate([np.zeros(len(first), bool), np.ones(len(ms), bool)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[first], ms]), pa.int64(), mask=nulls),
                    pa.array(np.concatenate([c[first], ms]), pa.int64(), mask=nulls),
                    ids.take(pa.array(doc[at])),
                    pa.array(keys[doc[at]], pa.int64()),
                    pa.array(np.concatenate([pos[first], ms]) + base, pa.int64()),
                    pa.array(np.concatenate([pos[first] - lo[first], 0 * ms]), pa.int32()),
                    pa.array(np.concatenate([size[first] - pos[first], me - ms]), pa.int32()),
                    pa.array(np.concatenate([copies, 0 * ms]), pa.int32()),
                ],
                [x.split()[0] for x in ANCHOR.split(", ")],
            )

    return arrow_map(docs.select("doc_id", "text_key", "text"), rows, ANCHOR)


SORTED = "kind int, digest binary, salt int, doc_id long, text_key long, begin long, until long"


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Sort the contexts of each (h, salt), which stand together, and tell what repeats.

    kind 0: a repeat [begin, until). For hashes dealt over several salts also kind 1, the digest of a
    window of this block, and kind 2, a window that nothing in its block has covered.
    """

    def emit(group: list, blocks: int, out: list) -> None:
        if len(group) > 1:
            found = repeats([g["l"] for g in group], [g["r"] for g in group], length)
        else:
            found = [(0, 0)] * len(group)
        seen = set()
        for g, (x, y) in zip(group, found):
            if x + y and not g["whole"]:
                out.append((0, None, None, g["d"], g["k"], g["pos"] - x, g["pos"] + y))
            if blocks > 1:
                text = g["l"][::-1] + g["r"]
                left = len(g["l"])
                for s in range(len(text) - length + 1):
                    digest = hashlib.blake2b(text[s : s + length], digest_size=16).digest()
                    seen.add(digest)
                    if not g["whole"] and not (left - s <= x and s + length - left <= y):
                        out.append((2, digest, g["salt"], g["d"], g["k"], g["pos"] - left + s, g["pos"] - left + s + length))
        out.extend((1, digest, group[0]["salt"], None, None, None, None) for digest in seen)

    def batch_of(out: list) -> pa.RecordBatch:
        types = [pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*out)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], [x.split()[0] for x in SORTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, blocks, out = None, [], 1, []
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for h, salt, n, left, text, whole, d, k, pos in zip(*(cols[c] for c in ("h", "salt", "blocks", "left", "context", "whole", "doc_id", "text_key", "pos"))):
                if (h, salt) != key:
                    if group:
                        emit(group, blocks, out)
                    key, group = (h, salt), []
                    if len(out) > 5000:
                        yield batch_of(out)
                        out = []
                blocks = n
                group.append({"l": text[:left][::-1], "r": text[left:], "whole": whole, "d": d, "k": k, "pos": pos, "salt": salt})
        if group:
            emit(group, blocks, out)
        yield batch_of(out)

    return map_batches(contexts, run, SORTED)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (h, c, blocks, whole, at), cut from their documents."""
    per_doc = wanted.groupBy(F.col("at.doc_id").alias("_d"), F.col("at.text_key").alias("_k")).agg(
        F.collect_list(F.struct("h", "salt", "blocks", "whole", "at.pos", "at.left", "at.right")).alias("cuts")
    )
    joined = docs.join(per_doc, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["text_key"] == F.col("_k")))
    # Repeated rows give their contexts twice; these are repeated as a whole, so only witnesses.
    schema = "h long, salt int, blocks int, left int, context binary, whole boolean, doc_id long, text_key long, pos long"

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for d, k, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = text.encode()
            for x in cuts:
                out.append((x["h"], x["salt"], x["blocks"], x["left"], raw[x["pos"] - x["left"] : x["pos"] + x["right"]], x["whole"], d, k, x["pos"]))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*out)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], [x.split()[0] for x in schema.split(", ")])

    return arrow_map(joined.select("doc_id", "text_key", "text", "cuts"), cut, schema)


def repeated_spans(docs: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, begin, until) of stretches that the repeats cover; they may overlap."""
    rows = materialize(anchor_rows(docs, length), "anchors")
    local = rows.where("h is null").select("doc_id", "text_key", F.col("pos").alias("begin"), (F.col("pos") + F.col("right")).alias("until"))
    # Aggregates are written before they are joined: Spark can then split a hot hash in the join.
    hashes = materialize(rows.where("h is not null").groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h"), "hashes")
    found = materialize(rows.join(hashes, "h", "left_semi"), "candidates")
    contexts = materialize(
        found.groupBy("h", "c").agg(F.sum("copies").alias("n"), F.min(F.struct("doc_id", "text_key", "pos", "left", "right")).alias("at")), "contexts"
    )
    whole = contexts.where("n > 1").select("h", "c")
    spans = found.join(whole, ["h", "c"], "left_semi").select("doc_id", "text_key", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("right")).alias("until"))
    several = materialize(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "several")
    wanted = contexts.join(several, "h").select(
        "h", "c", (F.col("n") > 1).alias("whole"), "at", F.ceil(F.col("d") / block).cast("int").alias("blocks")
    ).withColumn("salt", F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int"))
    ordered = _contexts(docs, wanted).repartition("h", "salt").sortWithinPartitions("h", "salt")
    result = materialize(_sorted_groups(ordered, length), "repeats")
    mark = result.where("kind = 0").select("doc_id", "text_key", "begin", "until")
    shared = result.where("kind = 1").groupBy("digest").agg(F.min("salt").alias("a"), F.max("salt").alias("z")).where("a != z").select("digest")
    across = result.where("kind = 2").join(shared, "digest", "left_semi").select("doc_id", "text_key", "begin", "until")
    return local.union(spans).union(mark).union(across)


CUT = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType())])


def with_cut(docs: DataFrame, length: int, block: int, *keep: str, as_text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id, text) and n_bytes, n_removed, n_spans and kept.

    With ``as_text`` kept is a string: bytes of letters that a cut splits go too, and nothing else.
    """
    docs = docs.select(*keep, F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    docs = docs.withColumn("_key", F.xxhash64("_text"))
    spans = repeated_spans(docs.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_key").alias("text_key")), length, block)
    per_doc = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_set(F.struct("begin", "until")).alias("_spans"))
    joined = docs.join(per_doc, docs["_id"].eqNullSafe(F.col("_d")) & (docs["_key"] == F.col("_k")), "left").select(*keep, "_text", "_spans")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_bytes, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
            raw = text.encode()
            at, n, gone, left = 0, 0, 0, []
            end = -1
            for s, e in sorted((x["begin"], x["until"]) for x in spans or ()):
                if s > end:
                    n += 1
                    left.append(raw[at:s])
                    end = s
                if e > end:
                    gone += e - end
                    end = at = e
            left.append(raw[at:])
            n_bytes.append(len(raw))
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(left))
        rest = pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), rest],
            [*keep, *CUT.names],
        )

    made = [*CUT.fields[:-1], StructField("kept", StringType())] if as_text else CUT.fields
    return arrow_map(joined, cut, StructType([*joined.schema.fields[:-2], *made]))


def suffix_dedup(documents: DataFrame, length: int = 400, block: int = BLOCK) -> DataFrame:
    """Cut from every text the bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes
    in order, binary), one row for each row of ``documents``; other columns are ignored. All
    copies of a repeat go, also overlapping ones and those inside one document; matches do not
    cross documents. Null texts count as empty. Repeated rows are separate documents, so theirs are
    removed. Null ids are allowed. Texts shorter than ``length`` stay whole.
    """
    return with_cut(documents, length, block, "doc_id")
