"""Best-fit packing of token sequences by bulk-synchronous sweeps over range-sorted documents and gaps.

Documents become pieces of at most ``capacity`` tokens. Pieces of more than half of it open a sequence each. The
others follow in classes of falling length, each in rounds until all its pieces have a place:

1. Pieces and gaps are range-sorted together, largest first. Each range is swept: a piece goes to its
   successor, the smallest gap of the range that takes it, and the gap goes on with what is left of it.
2. What is left over in the ranges is ranked on one tape of tokens: a gap moves the place on the tape up, a
   piece moves it down, so that a piece stands beside the smallest gap above it that no larger piece
   has taken. Stretches of the tape are swept like ranges; where several pieces want one gap, the tape's
   order decides.
3. Gaps are updated. For the pieces that found none, as many sequences are opened as their tokens fill,
   and the next round begins.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.llm.common import arrow_map, map_batches, materialize

#: Chunks of text that a worker remembers the ids of, and the longest of them.
REMEMBER, LONGEST = 600_000, 40
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder(dict):
    """Ids of a byte-level BPE tokenizer file, with a memory of chunks: a space and what follows up to the next.

    No token of this kind of tokenizer spans from a non-space to a space, so a text without two white
    spaces in a row is the sum of its chunks; chunks go through the merges as ranks of the file's
    vocabulary. Other texts, and those that may hold special tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        from skiff.llm.segment_bpe import byte_letters

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        # The pattern of the byte-level pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merge = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.merge(" " + chunk)).tobytes()
        if len(self) < REMEMBER and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if _WHOLE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.merge(first)).tobytes() + b"".join(map(self.__getitem__, rest))


_WHOLE = re.compile(r"\s[ ]|<\||\s\Z")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of every document: its ids, then ``end_id``, cut at ``capacity`` from the end back."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), array("I", [end_id]).tobytes()
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = enc.encode(text or "") + tail
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            cuts = [0, *range(first, n + 1, capacity)]
            for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
                for col, v in zip(out, (doc, p, a, z - a, zlib.crc32(ids[4 * a : 4 * z]))):
                    col.append(v)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], [x.split()[0] for x in PIECE.split(", ")])

    return arrow_map(documents.select("doc_id", "text"), rows, PIECE)


GAP, LEFT, PLACED = 0, 1, 2
#: A gap has kind, size and key (its sequence) only; key is the number of a piece, and size its length.
ROW = "kind int, size long, key long, stretch long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long, at long"
GIVEN = [x.split()[0] for x in ROW.split(", ")][:-3]
#: Tokens of one stretch of the tape, in sequences, for the longest pieces; shorter ones have shorter stretches, of two at least.
STRETCH = 16


class Gaps:
    """Gaps by size, with the successor of a length in one step: sizes that are there are bits of a number."""

    def __init__(self) -> None:
        self.there, self.of = 0, {}

    def put(self, size: int, key: int) -> None:
        if size:
            self.of.setdefault(size, []).append(key)
            self.there |= 1 << size

    def take(self, length: int) -> tuple[int, int] | None:
        """The smallest gap that takes ``length``, the last one put of that size."""
        fit = self.there >> length
        if not fit:
            return None
        size = length + (fit & -fit).bit_length() - 1
        keys = self.of[size]
        key = keys.pop()
        if not keys:
            del self.of[size]
            self.there ^= 1 << size
        return size, key


def sweep(rows: DataFrame, capacity: int) -> DataFrame:
    """Best-fit of the pieces of each run of equal ``stretch`` in a partition; rows are in falling order of size, gaps first.

    Pieces come out placed or left, gaps with the sizes that they have then. ``at`` is the lower end of what is
    left over on a tape that begins at 0: pieces downwards first, then gaps upwards.
    """
    names = [x.split()[0] for x in ROW.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64()}
    kinds = [types[x.split()[1]] for x in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, down, stretch = Gaps(), 0, None

        def rest() -> pa.RecordBatch:
            pairs = [(size, key) for size in sorted(gaps.of, reverse=True) for key in gaps.of[size]]
            place, low = [], -down
            for size, _ in pairs:
                place.append(low)
                low += size
            n = len(pairs)
            known = {"kind": [GAP] * n, "size": [p[0] for p in pairs], "key": [p[1] for p in pairs], "at": place}
            return pa.RecordBatch.from_arrays([pa.array(known[c], t) if c in known else pa.nulls(n, t) for c, t in zip(names, kinds)], names)

        for batch in batches:
            col = {c: batch.column(i).to_pylist() for i, c in enumerate(GIVEN[:4])}
            mine, kind, sequence, offset, at = [], [], [], [], []
            for i, (k, size, key, x) in enumerate(zip(col["kind"], col["size"], col["key"], col["stretch"])):
                if x != stretch:
                    if gaps.of:
                        yield rest()
                    gaps, down, stretch = Gaps(), 0, x
                if k == GAP:
                    gaps.put(size, key)
                    continue
                mine.append(i)
                hit = gaps.take(size)
                if hit is None:
                    down += size
                    kind.append(LEFT), sequence.append(None), offset.append(None), at.append(-down)
                else:
                    gaps.put(hit[0] - size, hit[1])
                    kind.append(PLACED), sequence.append(hit[1]), offset.append(capacity - hit[0]), at.append(None)
            docs = batch.take(pa.array(mine, pa.int64()))
            new = {"kind": kind, "sequence_id": sequence, "offset": offset, "at": at}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], t) if c in new else docs.column(i) for i, (c, t) in enumerate(zip(names, kinds))], names)
        if gaps.of:
            yield rest()

    return map_batches(rows.select(GIVEN), run, ROW)


def _round(docs: DataFrame, gaps: DataFrame, capacity: int, stretch: int, shift: int) -> tuple[DataFrame, DataFrame]:
    """The rows after the sweeps of ranges, and after those of stretches of the tape that hold what these left."""
    order = [F.col("size").desc(), "kind", "key"]
    union = docs.unionByName(gaps, allowMissingColumns=True).withColumn("stretch", F.lit(0).cast("long"))
    dealt = union.repartitionByRange(*order).sortWithinPartitions(*order)
    first = sweep(dealt, capacity).withColumn("stretch", F.spark_partition_id().cast("long"))
    first = materialize(first, "ranges")
    left = first.where(F.col("kind") != PLACED)
    # One row for each task: where its part of the tape begins.
    moved = left.groupBy("stretch").agg(F.sum(F.when(F.col("kind") == GAP, F.col("size")).otherwise(-F.col("size"))).alias("moved"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = moved.select("stretch", F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("_begin"))
    place: Column = F.floor((F.col("at") + F.col("_begin") + shift) / stretch)
    taped = left.join(F.broadcast(begins), "stretch").withColumn("stretch", place.cast("long"))
    second = sweep(taped.repartition("stretch").sortWithinPartitions("stretch", *order), capacity)
    return first, materialize(second, "stretches")


def pack(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, as few as best-fit in bulk needs.

    Returns one row for each piece: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), sequence_id and offset
    (gapless from 0). Only documents longer than ``capacity`` are cut; their first piece may be
    shorter. A null or empty text is the end id alone. Repeated rows and null ids are packed
    like others; columns besides doc_id and text are ignored. An empty table gives an empty one.
    """
    cut = pieces(documents, tokenizer, capacity, end_id)
    # Written once with a number for each piece, so that a row is told from its repetitions.
    cut = materialize(cut.withColumnRenamed("length", "size").withColumn("key", F.monotonically_increasing_id()), "pieces")
    # Classes halve twice, then go by four and take the rest: fewer rounds where pieces only fill up.
    bounds = [x for x in (capacity // 2, capacity // 4, capacity // 8, capacity // 32) if x] + [0]
    tokens = cut.agg(*[F.coalesce(F.sum(F.when((F.col("size") > a) & (F.col("size") <= b), F.col("size"))), F.lit(0)) for b, a in zip(bounds, bounds[1:])]).first()
    alone = cut.where(F.col("size") > bounds[0])
    placed = [alone.withColumns({"sequence_id": F.col("key"), "offset": F.lit(0).cast("long")})]
    gap = F.lit(GAP).alias("kind")
    gaps = [alone.where(F.col("size") < capacity).select(gap, (capacity - F.col("size")).alias("size"), "key")]
    opened, turn = 0, 0
    for b, a, left in zip(bounds, bounds[1:], tokens):
        stretch = capacity * max(2, STRETCH * b // bounds[0])
        docs = cut.where((F.col("size") > a) & (F.col("size") <= b)).withColumn("kind", F.lit(LEFT))
        # Gaps that no piece of the class fits wait; a round reads those that the round before it wrote, and no older ones.
        active, gaps = [g.where(F.col("size") > a) for g in gaps], [g.where(F.col("size") <= a) for g in gaps]
        while left:
            # A gap lies within one stretch every second round at least, so the rounds end.
            shift = turn % 2 * stretch // 2
            use = active[0]
            for g in active[1:]:
                use = use.unionByName(g)
            first, second = _round(docs, use, capacity, stretch, shift)
            placed += [x.where(F.col("kind") == PLACED) for x in (first, second)]
            active = [second.where(F.col("kind") == GAP).select("kind", "size", "key")]
            docs = second.where(F.col("kind") == LEFT).select("kind", "size", "key", "doc_id", "piece", "start", "ids_crc32")
            left = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            if left:
                new = -(-left // capacity)
                fresh = cut.sparkSession.range(opened, opened + new)
                active.append(fresh.select(gap, F.lit(capacity).cast("long").alias("size"), (-1 - F.col("id")).alias("key")))
                opened += new
            turn += 1
        gaps += active
    cols = ["doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", "sequence_id", "offset"]
    out = placed[0].select(cols)
    for x in placed[1:]:
        out = out.unionByName(x.select(cols))
    return out
