"""N-gram Jaccard join: grouped prefix join over the word shingles of documents.

Every document becomes a set of shingle hashes under one global order that puts shingles of
rare words first. Sets of Jaccard similarity t share a shingle among their first
``n - ceil(t * n) + 1`` ones. Documents with equal sets are one class; classes of equal prefix
and size are one group; groups meet on prefix shingles. The pairs of groups that pass the size and
place filters expand into members, and the members are verified on their whole sets.

A large cluster of near copies would give all its pairs. So each shingle and each group first
pairs its members with one pivot only; after these links are verified and joined into
components, a second pass takes every pair left over that is not in one component. No link
between components can be missed, and hot shingles do not multiply within a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import ceil
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiff.llm.common import arrow_map, map_batches, materialize
from skiff.llm.textkit import Words, shingles, slices, utf8

#: Counters of the word frequency sketch, and the parts in which tasks hand it on.
BUCKETS, PARTS = 1 << 18, 32
#: 64-bit words of the bitmap that rows carry into the joins on a shingle.
SHORT = 16


def word_frequency(docs: DataFrame) -> np.ndarray:
    """log2 of the corpus frequency of each bucket of word hashes, over every word of every document.

    The sketch has a fixed size. It only sets the global order of shingles, so what words of one
    bucket share changes the number of candidates and never the result.
    """
    size = BUCKETS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                at = offsets[i : j + 1]
                h = Words(data[at[0] : at[-1]], at - at[0]).hashes(lower=True)
                total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        blobs = [total[p * size : (p + 1) * size].astype(np.int32).tobytes() for p in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[p] = total.get(p, 0) + np.frombuffer(blob, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    summed = map_batches(map_batches(docs.select("text"), count, schema).repartition(PARTS, "part"), add, schema)
    out = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():  # PARTS rows of fixed size
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.counts, np.int64)
    return np.round(np.log2(out + 1.0) * 4).astype(np.uint8)


def required(n: int, t: Fraction) -> int:
    """The least overlap of a set of size n with any set at similarity t."""
    return ceil(n * t)


def doc_sets(batch: pa.RecordBatch, k: int, cost: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(row, sorted distinct shingle hashes, costs in that order) of each text of a batch."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    for i, j in slices(offsets):
        at = offsets[i : j + 1]
        words = Words(data[at[0] : at[-1]], at - at[0])
        h = words.hashes(lower=True)
        doc, value = shingles(words, h, k)
        weight = None
        if cost is not None:
            c = cost[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int32)
            n = len(c)
            weight = np.zeros(len(value), np.int32)
            if n >= k:
                # No shingle is more frequent than its rarest word; sums order those alike.
                each = [c[x : n - k + 1 + x] for x in range(k)]
                full = np.minimum.reduce(each) * 4096 + sum(each)
                full = full[words.doc[: n - k + 1] == words.doc[k - 1 :]]
                weight[: len(full)] = full
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(j - i + 1))
        for d in range(j - i):
            mine = order[edges[d] : edges[d + 1]]
            u, first = np.unique(value[mine], return_index=True)
            yield i + d, u, weight[mine[first]] if weight is not None else None


def parity(u: np.ndarray, words: int = 0) -> np.ndarray:
    """A bitmap of at least two bits for each hash, or of fixed size: bit i is the parity of the hashes that fall on i.

    Two bitmaps differ in no more bits than their sets differ in members. Its length is a power of two,
    and its halves xored are the bitmap of half the length.
    """
    words = words or 1 << max(0, (len(u) - 1) // 32).bit_length()
    bits = np.bincount((u >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


SIGNS = [f"s{i}" for i in range(SHORT)]
SKETCH = "doc_id long, text_key long, n long, fp binary, gid long, prefix array<long>, bits array<long>, " + ", ".join(f"{s} long" for s in SIGNS)


def sketches(docs: DataFrame, k: int, t: Fraction, cost: np.ndarray) -> DataFrame:
    """n (set size), fp (digest of the set), gid (of size and prefix), the prefix in order, and the bitmap."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, fp, gid, prefix, bits, short = [], [], [], [], [], []
        for _, u, w in doc_sets(batch, k, cost):
            n.append(len(u))
            fp.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
            take = len(u) - required(len(u), t) + 1 if len(u) else 0
            best = u[np.lexsort((u, w))[:take]].view(np.int64)
            prefix.append(best)
            gid.append(int.from_bytes(hashlib.blake2b(best.tobytes(), digest_size=8, salt=len(u).to_bytes(8, "big")).digest(), "big", signed=True))
            bits.append(parity(u))
            short.append(parity(u, SHORT))
        signs = np.array(short, np.int64).reshape(-1, SHORT)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(gid, pa.int64()), pa.array(prefix, longs), pa.array(bits, longs), *(pa.array(signs[:, i]) for i in range(SHORT))],
            [x.split()[0] for x in SKETCH.split(", ")],
        )

    return arrow_map(docs, rows, SKETCH)


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """fp and the whole set of each document."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp, sets = [], []
        for _, u, _ in doc_sets(batch, k, None):
            fp.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
            sets.append(u.view(np.int64))
            if sum(map(len, sets)) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["fp", "set"])
                fp, sets = [], []
        yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["fp", "set"])

    return arrow_map(docs, rows, "fp binary, set array<long>").dropDuplicates(["fp"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``links`` (a, b).

    Min labels over the neighbours with pointer jumping; each round is written to the shared folder.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        seen = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        near = label.join(seen, label["node"] == seen["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        step = near.join(jump, "low").select("node", "old", F.least("low", "far").alias("comp"))
        step = materialize(step, "labels")
        label = step.select("node", "comp")
        if step.where(F.col("old") != F.col("comp")).isEmpty():
            return label


def _may_link(pairs: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, na, ba, b, nb, bb) whose sizes and bitmaps do not rule out similarity t.

    The longer bitmap is halved to the length of the other. Sets of similarity t differ in size by the
    factor 1 / t at most, so their bitmaps, of powers of two, by that rounded up to one.
    """

    def half(bits, size):
        return F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))

    least = F.least(F.size("ba"), F.size("bb"))
    times = (-(-t.denominator // t.numerator) - 1).bit_length()

    def folded(bits):
        if times < 2:
            return F.when(F.size(bits) > least, half(bits, least)).otherwise(bits)
        turns = F.array(*[F.lit(i) for i in range(times)])
        return F.aggregate(turns, bits, lambda s, _: F.when(F.size(s) > least, half(s, F.shiftright(F.size(s), 1))).otherwise(s))

    x, y = folded(F.col("ba")), folded(F.col("bb"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    total = F.col("na") + F.col("nb")
    sizes = (F.col("na") * t.denominator >= F.col("nb") * t.numerator) & (F.col("nb") * t.denominator >= F.col("na") * t.numerator)
    near = (total - differ) * (t.numerator + t.denominator) >= total * 2 * t.numerator
    return pairs.where(sizes).where(near)


def _meetings(x: DataFrame, y: DataFrame, close: Column) -> DataFrame:
    """Pairs of groups on one shingle, but for those that meet on one and the same shingle just before it as well."""
    met = F.coalesce(F.col("x_prev") == F.col("y_prev"), F.lit(False))
    return x.join(y, "token").where((F.col("x_gid") < F.col("y_gid")) & ~met & close)


#: Further passes from other pivots before all pairs that are left.
TURNS = 2
#: Documents to verify that may be broadcast as keys; more are joined by shuffle.
SMALL = 200_000


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of set digests with similarity t at least, on whole sets made from the texts again."""
    fps = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    wanted = materialize(classes.join(fps, "fp").select(F.col("at.doc_id").alias("_d"), F.col("at.text_key").alias("_k")).distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    texts = docs.join(few, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["text_key"] == F.col("_k")), "left_semi")
    sets = materialize(whole_sets(texts.select("text"), k), "sets")
    left = sets.select(F.col("fp").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb").cast("long") - inter
    return materialize(both.where(inter * t.denominator >= union * t.numerator).select("a", "b"), "links")


def _components(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """doc_id, text_key, n and comp (a digest; null for empty sets) of each row of docs (doc_id, text, text_key)."""
    cost = word_frequency(docs)
    found = materialize(sketches(docs, k, t, cost), "sketches")
    classes = materialize(
        found.where("n > 0")
        .groupBy("fp")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at"), F.min("n").alias("n"), F.min("gid").alias("gid"), F.min("bits").alias("bits"), *[F.min(s).alias(s) for s in SIGNS]),
        "classes",
    )
    comps = _class_components(docs, found, classes, k, t)
    out = found.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp"))
    return out.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("doc_id", "text_key", "n", F.coalesce("comp", "fp").alias("comp"))


def jaccard_components(documents: DataFrame, k: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """Components of documents whose sets of k-word shingles have at least the threshold's similarity.

    Returns doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself
    included), one row for each row of ``documents``; columns besides doc_id and text are ignored.

    A-Z count as a-z. Null and empty texts, and texts without words, have empty sets, link with
    nothing and are their own components. Repeated rows each give a row. A null doc_id never names a
    component unless all ids of it are null. Equal sets are one class, so their copies meet at
    no cost. An empty table gives an empty table.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = materialize(_components(docs, k, Fraction(threshold)), "components")
    # Written, so that the join below has plain exchanges on both sides, which Spark can split at a hot component.
    heads = materialize(found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "heads")
    return found.join(heads, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def drop_near_copies(documents: DataFrame, k: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """The rows of ``documents`` without near copies: of each component the row with the smallest doc_id.

    A null id comes last; rows with equal id and text are one. Rows with empty sets all stay but for
    those. All columns are kept.
    """
    least = F.lit(-(1 << 63))
    docs = documents.select(F.struct("*").alias("_row"), F.coalesce("doc_id", least).alias("_id"), F.xxhash64("text").alias("_key"))
    found = materialize(_components(documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")), k, Fraction(threshold)), "components")
    best = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at")).select("at.doc_id", "at.text_key")
    stay = best.union(found.where("comp is null").select("doc_id", "text_key")).select(F.coalesce("doc_id", least).alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(stay, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("_row.*")


def _class_components(docs: DataFrame, found: DataFrame, classes: DataFrame, k: int, t: Fraction) -> DataFrame:
    num, den = t.numerator, t.denominator
    tokens = found.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", (F.col("n") * (1 << 32) + F.col("pos")).alias("at"))
    shared = tokens.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("top")).where("low != top").select("token")
    member = classes.select("gid", "fp", "n", "bits", *SIGNS)
    # One member of each group speaks for it in the first pass; short bitmaps only for groups of one.
    groups = materialize(
        member.groupBy("gid").agg(F.min(F.struct("fp", "n", "bits")).alias("rep"), F.count(F.lit(1)).alias("c"), *[F.min(s).alias(s) for s in SIGNS]), "groups"
    )
    # Prefix shingles that two groups at least have. A group with many of them, and with common ones, is
    # near the middle of its cluster, where few own changes come before what all share: a good pivot.
    meet = tokens.join(shared, "token", "left_semi").groupBy("token", "gid").agg(F.min("at").alias("at"))
    meet = meet.select("token", "gid", F.shiftright("at", 32).alias("n"), (F.col("at") % (1 << 32)).alias("pos"))
    # Pairs of groups that have one and the same shared shingle before this one meet there already, at places that
    # allow no less. So shingles that come after one other shingle in all their groups bring no pair and drop out.
    meet = materialize(meet.withColumn("prev", F.lag("token").over(Window.partitionBy("gid").orderBy("pos"))), "prefixes")
    leads = meet.groupBy("token").agg(F.count_if(F.col("prev").isNull()).alias("firsts"), F.min("prev").alias("a"), F.max("prev").alias("z"))
    meet = materialize(meet.join(leads.where("firsts > 0 or a != z").select("token"), "token", "left_semi"), "shared")
    weight = meet.join(meet.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "token").groupBy("gid").agg(F.sum("c").alias("weight"))
    sig = groups.select("gid", (F.col("c") == 1).alias("solo"), *SIGNS).join(weight, "gid")
    meet = materialize(meet.join(sig, "gid"), "meeting")

    def sides(df: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        cols = ("gid", "n", "pos", "solo", *SIGNS, *more)
        return tuple(df.select("token", *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in "xy")

    def fields(side: str, of: DataFrame, gid: str, *more: str) -> DataFrame:
        return of.select(F.col("gid").alias(gid), F.col("fp").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"b{side}"), *[F.col(c).alias(f"{c}_{side}") for c in more])

    # Sizes, places (if the shingle there is the first common one) and short bitmaps that allow similarity t.
    x_n, y_n = F.col("x_n"), F.col("y_n")
    most = F.least(x_n - F.col("x_pos"), y_n - F.col("y_pos"))
    differ = reduce(add, [F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in SIGNS])
    close = (
        (x_n * den >= y_n * num) & (y_n * den >= x_n * num) & (most * (den + num) >= (x_n + y_n) * num)
        & (~F.col("x_solo") | ~F.col("y_solo") | ((x_n + y_n - differ) * (num + den) >= (x_n + y_n) * 2 * num))
    )
    reps = groups.select("gid", "rep.fp", "rep.n", "rep.bits")
    cols = ["a", "na", "ba", "b", "nb", "bb"]

    def expanded(pairs: DataFrame) -> DataFrame:
        return pairs.join(fields("a", reps, "x_gid"), "x_gid").join(fields("b", reps, "y_gid"), "y_gid").select(cols)

    def ordered(pairs: DataFrame) -> DataFrame:
        return _may_link(pairs, t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    lead = meet.groupBy("token").agg(F.max(F.struct("weight", "gid")).alias("top")).select("token", F.col("top.gid").alias("pivot"))
    led = meet.join(lead, "token")
    pivots, others = sides(led.where("gid = pivot"))[0], sides(led.where("gid != pivot"))[1]
    stars = expanded(pivots.join(others, "token").where(close).select("x_gid", "y_gid").distinct())
    several = groups.where("c > 1").select("gid", F.col("rep.fp").alias("a"), F.col("rep.n").alias("na"), F.col("rep.bits").alias("ba"))
    inner = member.join(several, "gid").where("fp != a").select("a", "na", "ba", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    tried = materialize(ordered(stars.union(inner.select(cols))), "pairs")
    comps = connected_components(_verified(docs, classes, tried, k, t))
    meeting = materialize(member.join(meet.select("gid").union(several.select("gid")).distinct(), "gid"), "members")

    def across(comps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Components of members, their range in each group, and the prefix shingles that meet several."""
        label = materialize(meeting.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "labelled")
        span = label.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        spread = meet.join(span, "gid")
        crossed = spread.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l != h").select("token")
        return label, span, materialize(spread.join(crossed, "token", "left_semi"), "open")

    # Then across components only. Stars from other pivots come first where the first ones say that most
    # pairs are still near: a cluster that its pivot links in part would give all its pairs.
    for turn in range(TURNS + 1):
        label, span, left_over = across(comps)
        if turn == TURNS:
            break
        by_comp = left_over.groupBy("token", "lo").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct(F.xxhash64("gid", F.lit(turn)), "gid")).alias("gid"))
        tops = by_comp.groupBy("token").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "lo", "gid")).alias("top"))
        led = left_over.join(tops.select("token", "rows", F.col("top.lo").alias("lead"), F.col("top.gid.gid").alias("pivot")), "token")
        pivots, others = sides(led.where("gid = pivot"))[0], sides(led.where("(lo != lead or hi != lead) and gid != pivot"), "rows")[1]
        near = materialize(pivots.join(others, "token").where(close).select("x_gid", "y_gid", "y_rows"), "stars")
        ahead = near.agg(F.coalesce(F.sum("y_rows"), F.lit(0))).first()[0]  # what pairs of all with all would come to
        if ahead <= 4 * meet.count():
            break
        fresh = ordered(expanded(near.select("x_gid", "y_gid").distinct()))
        fresh = materialize(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(fresh)
        more = _verified(docs, classes, fresh, k, t)
        if more.isEmpty():
            break
        known = comps.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        comps = connected_components(known.union(more))

    # Last, every pair of groups of one shingle, and of members of one group, that is still across.
    x, y = sides(left_over, "prev", "lo", "hi")
    one = (F.col("x_lo") == F.col("x_hi")) & (F.col("y_lo") == F.col("y_hi")) & (F.col("x_lo") == F.col("y_lo"))
    crossing = _meetings(x, y, ~one & close).select("x_gid", "y_gid").distinct()
    outer = crossing.join(fields("a", label, "x_gid", "comp"), "x_gid").join(fields("b", label, "y_gid", "comp"), "y_gid").where("comp_a != comp_b")
    within = label.join(span.where("lo != hi").select("gid"), "gid", "left_semi")
    within = fields("a", within, "_gid", "comp").join(fields("b", within, "_gid", "comp"), "_gid").where("a < b and comp_a != comp_b")
    second = ordered(outer.select(cols).union(within.select(cols)))
    second = materialize(second.join(tried, ["a", "b"], "left_anti"), "pairs")
    if second.isEmpty():
        return comps
    known = comps.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return connected_components(known.union(_verified(docs, classes, second, k, t)))
