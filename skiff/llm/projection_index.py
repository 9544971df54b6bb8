"""Approximate nearest neighbours with low-dimensional stable projections indexed by kd-trees.

1. Every vector is projected on a few Gaussian (2-stable) directions. A kd-tree over the projections of a bounded
   sample cuts the projected space into cells, and every vector goes to its cell. In each cell, or
   part of a large one, a kd-tree of its own makes leaves of some dozens of vectors, written once as rows.
2. A query takes cells in the order of their distance in the projection, in three turns: the nearest one, a
   few more, the others. In a cell it takes leaves in that order too, and verifies the true distance of the points
   whose projected distance may still matter.
3. It stops by a chi-square test. (Projected / true distance) squared is chi-square distributed, so a point
   nearer than the k-th best so far projects beyond ``limit`` times that distance with a small probability
   only. Cells, leaves and points beyond it are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skiff.llm.common import arrow_map, map_batches, materialize

#: Directions, vectors to a leaf, vectors of a cell that one task holds, queries that one copy of them serves.
DIRECTIONS, LEAF, PART, SERVED = 16, 64, 32768, 4096
#: Vectors in the sample that the cells are cut by, and the least and most cells, over all lengths of vectors; between
#: them there is a cell for each PART vectors.
SAMPLE, CELLS, MOST_CELLS = 16384, 64, 1024
#: Rows of a table of cells that may be broadcast.
FEW = 100_000
#: Cells a query has taken after each turn; the last turn takes all that are left.
TURNS = (1, 8)


def chi_square_quantile(p: float, k: int) -> float:
    """The p-quantile for an even number of degrees of freedom, by bisection on the closed form."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(rows of each leaf, lower and upper corners of its box): median splits on the widest side."""
    rows, low, high = [], [], []
    stack = [np.arange(len(points))] if len(points) else []
    while stack:
        of = stack.pop()
        box = points[of]
        a, b = box.min(0), box.max(0)
        if len(of) <= leaf or (a == b).all():
            rows.append(of)
            low.append(a)
            high.append(b)
            continue
        d = int((b - a).argmax())
        order = np.argsort(box[:, d], kind="stable")
        stack += [of[order[len(of) // 2 :]], of[order[: len(of) // 2]]]
    return rows, np.array(low), np.array(high)


def cut_cells(points: np.ndarray, least: int) -> list:
    """Median splits down to at least ``least`` points: (side, value, left, right), or the number of a cell."""
    made = 0

    def grow(of: np.ndarray) -> object:
        nonlocal made
        box = points[of]
        spread = box.max(0) - box.min(0) if len(of) else np.zeros(1)
        d = int(spread.argmax())
        if len(of) < 2 * least or not spread[d]:
            made += 1
            return made - 1
        value = float(np.median(box[:, d]))
        low = box[:, d] < value
        if not low.any():  # the median is the least value, which many have
            low = box[:, d] <= value
        return d, value, grow(of[low]), grow(of[~low])

    return [grow(np.arange(len(points))), made]


def cell_of(tree: object, points: np.ndarray) -> np.ndarray:
    """The cell of every point."""
    out = np.zeros(len(points), np.int32)
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, of = stack.pop()
        if isinstance(node, int):
            out[of] = node
        else:
            d, value, left, right = node
            low = points[of, d] < value
            stack += [(left, of[low]), (right, of[~low])]
    return out


def lines(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, DIRECTIONS))


def flat(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Cell:
    """The leaves of a cell or of a part of one, as a task holds them."""

    def __init__(self) -> None:
        self.leaves: list[tuple] = []
        self.made = False

    def add(self, low: list, high: list, rows: list, ids: list, p: np.ndarray, v: np.ndarray) -> None:
        self.leaves.append((low, high, rows, ids, p, v))

    def close(self, dim: int) -> None:
        if not self.made and self.leaves:
            low, high, rows, ids, p, v = zip(*self.leaves)
            self.low, self.high = np.array(low), np.array(high)
            size = [len(x) for x in rows]
            self.at = np.concatenate([[0], np.cumsum(size)])
            self.rows, self.ids = np.concatenate(rows), np.concatenate(ids)
            self.p, self.v = np.concatenate(p).reshape(-1, DIRECTIONS), np.concatenate(v).reshape(-1, dim)
        self.made = True

    def search(self, row: int, p: np.ndarray, v: np.ndarray, k: int, limit: float, bound: float) -> tuple[list[tuple[int, int, float]], int]:
        """(the k nearest found as (row, id, squared distance), vectors verified); ``bound`` is the k-th best elsewhere."""
        if not self.leaves:
            return [], 0
        away = (np.maximum(0, np.maximum(self.low - p, p - self.high)) ** 2).sum(1)
        order = np.argsort(away, kind="stable")
        best, who, seen, s, step = np.zeros(0), np.zeros(0, np.int64), 0, 0, 4
        while s < len(order) and not away[order[s]] > limit * bound:
            take = order[s : s + step]
            take = take[~(away[take] > limit * bound)]
            at = np.concatenate([np.arange(self.at[i], self.at[i + 1]) for i in take.tolist()])
            at = at[self.rows[at] != row]
            if math.isfinite(bound):
                at = at[((self.p[at] - p) ** 2).sum(1) <= limit * bound]
            seen += len(at)
            if len(at):
                d = np.add.accumulate((self.v[at] - v) ** 2, axis=1)[:, -1]  # summed in order, as plain loops do
                best, who = np.concatenate([best, d]), np.concatenate([who, at])
                top = np.lexsort((self.rows[who], self.ids[who], best))[:k]
                best, who = best[top], who[top]
                if len(best) == k:
                    bound = min(bound, float(best[-1]))
            s, step = s + step, 2 * step
        return list(zip(self.rows[who].tolist(), self.ids[who].tolist(), best.tolist())), seen


LEAVES = "dim int, cell int, sub int, low array<double>, high array<double>, rows array<long>, ids array<long>, p array<double>, v array<double>"
FOUND = "query_row long, query_id long, row long, vec_id long, d double, verified long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def build_index(embeddings: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, dict[int, list]]:
    """(vectors that take part, leaves, cells of each length: (cell, parts, low, high))."""
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull()
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = embeddings.where(ok).where(good).select("vec_id", F.monotonically_increasing_id().alias("row"), F.size(v).alias("dim"), v.cast("array<double>").alias("v"))

    def project(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims, out = batch.column(2).to_numpy(), np.zeros((batch.num_rows, DIRECTIONS))
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            out[mine] = flat(batch.column(3).take(pa.array(mine)), dim) @ lines(dim, seed)
        yield batch.append_column("p", pa.array(list(out), pa.list_(pa.float64())))

    # Numbered and written once: a row is told from others of its id by its number.
    rows = materialize(arrow_map(rows, project, "vec_id long, row long, dim int, v array<double>, p array<double>"), "vectors")
    # The sample: about SAMPLE rows by a hash of their number, or all of fewer; projections only.
    count = rows.count()
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < (SAMPLE << 40) // max(1, count)
    sample = rows.where(share).select("dim", "p").orderBy("dim", "p").toPandas()
    least = -(-len(sample) // min(MOST_CELLS, max(CELLS, count // PART)))
    trees = {int(dim): cut_cells(np.array(g["p"].to_list()), max(LEAF // 4, least))[0] for dim, g in sample.groupby("dim")}

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims, out = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            out[mine] = cell_of(trees.get(dim, 0), flat(batch.column(4).take(pa.array(mine)), DIRECTIONS))
        yield batch.append_column("cell", pa.array(out))

    celled = arrow_map(rows, assign, "vec_id long, row long, dim int, v array<double>, p array<double>, cell int")
    # A row for each cell, so few but for tables of very many lengths; a cell of any size is dealt in parts of about PART vectors.
    sizes = materialize(celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    parts = F.ceil(F.col("n") / PART)
    dealt = celled.join(sizes, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), parts).cast("int"))
    keys = ["dim", "cell", "sub"]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made() -> pa.RecordBatch:
            rows, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            p, v = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            of, low, high = kd_leaves(p, LEAF)
            n = len(of)
            lists = [list(low), list(high), [rows[x] for x in of], [ids[x] for x in of], [p[x].ravel() for x in of], [v[x].ravel() for x in of]]
            kinds = [pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array([k] * n, pa.int32()) for k in key), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds))], _names(LEAVES))

        for batch in batches:
            each = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cut = np.concatenate([[0], np.flatnonzero((each[1:] != each[:-1]).any(1)) + 1, [len(each)]])
            for x, y in zip(cut.tolist(), cut[1:].tolist()):
                mine = tuple(each[x].tolist())
                if mine != key:
                    if held:
                        yield made()
                    key, held = mine, []
                part = batch.slice(x, y - x)
                held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), flat(part.column(5), DIRECTIONS), flat(part.column(6), mine[0])))
        if held:
            yield made()

    index = dealt.select(*keys, "row", "vec_id", "p", "v").repartition(*keys).sortWithinPartitions(*keys, "vec_id", "row")
    index = materialize(map_batches(index, leaves, LEAVES), "leaves")
    cells: dict[int, list] = {}
    ends = [F.min(F.element_at("low", i + 1)).alias(f"low{i}") for i in range(DIRECTIONS)] + [F.max(F.element_at("high", i + 1)).alias(f"high{i}") for i in range(DIRECTIONS)]
    for r in index.groupBy("dim", "cell").agg((F.max("sub") + 1).alias("parts"), *ends).collect():  # 2 * MOST_CELLS rows at most, and one for each rare length
        cells.setdefault(r["dim"], []).append((r["cell"], r["parts"], [r[f"low{i}"] for i in range(DIRECTIONS)], [r[f"high{i}"] for i in range(DIRECTIONS)]))
    return rows, index, cells


def _turn(queries: DataFrame, index: DataFrame, cells: dict[int, list], start: int, stop: int | None, k: int, limit: float) -> DataFrame:
    """What the queries (vec_id, row, dim, v, p, bound) find in the cells from place ``start`` to ``stop`` of their order."""
    asked = "dim int, cell int, sub int, query_row long, query_id long, p array<double>, v array<double>, bound double"

    def choose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, keys = [], []
        col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        for i, (dim, p, bound) in enumerate(zip(col["dim"].to_pylist(), col["p"].to_pylist(), col["bound"].to_pylist())):
            known, p = cells.get(dim, []), np.array(p)
            low, high = np.array([c[2] for c in known]), np.array([c[3] for c in known])
            away = (np.maximum(0, np.maximum(low - p, p - high)) ** 2).sum(1)
            for c in np.argsort(away, kind="stable")[start:stop].tolist():
                if not away[c] > limit * bound:
                    for sub in range(known[c][1]):
                        which.append(i)
                        keys.append((dim, known[c][0], sub))
        new = [pa.array([x[i] for x in keys], pa.int32()) for i in range(3)]
        rest = [col[c].take(pa.array(which, pa.int64())) for c in ("row", "vec_id", "p", "v", "bound")]
        yield pa.RecordBatch.from_arrays([*new, *rest], _names(asked))

    keys = ["dim", "cell", "sub"]
    asks = materialize(arrow_map(queries.select("dim", "row", "vec_id", "p", "v", "bound"), choose, asked), "asks")
    # Leaves of cells that are asked; where very many ask for one, copies of it share them.
    copies = asks.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("copies"))
    held = index.join(copies, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "low", "high", "rows", "ids", "p", "v")
    turns = asks.join(copies, keys).select(*keys, F.pmod(F.xxhash64("query_row"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "p", "v", "query_row", "query_id", "bound")
    both = held.unionByName(turns, allowMissingColumns=True).repartition(*keys, "copy").sortWithinPartitions(*keys, "copy", "kind")
    names = [*keys, "copy", "kind", "low", "high", "rows", "ids", "p", "v", "query_row", "query_id", "bound"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, Cell()
        for batch in batches:
            col, out = {c: batch.column(i) for i, c in enumerate(names)}, []
            each = list(zip(*(col[c].to_pylist() for c in (*keys, "copy"))))
            kind = col["kind"].to_pylist()
            for i in range(batch.num_rows):
                if each[i] != key:
                    key, cell = each[i], Cell()
                p, v = (col[c][i].values.to_numpy(zero_copy_only=False) for c in ("p", "v"))
                if not kind[i]:
                    cell.add(*(col[c][i].as_py() for c in ("low", "high", "rows", "ids")), p, v)
                    continue
                cell.close(key[0])
                row, asker = col["query_row"][i].as_py(), col["query_id"][i].as_py()
                hits, seen = cell.search(row, p, v, k, limit, col["bound"][i].as_py())
                out += [(row, asker, *h, 0) for h in hits]
                out.append((row, asker, None, None, None, seen))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 6, kinds)], _names(FOUND))

    return map_batches(both.select(names), search, FOUND)


def search_index(embeddings: DataFrame, every: int = 100, k: int = 10, confidence: float = 0.95, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(neighbours, verified): what ``nearest`` returns, and query_id, query_row and the vectors that each query verified."""
    rows, index, cells = build_index(embeddings, seed)
    limit = chi_square_quantile(confidence, DIRECTIONS)
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.withColumn("bound", F.lit(float("inf")))
    best, verified = None, None
    for start, stop in zip((0, *TURNS), (*TURNS, None)):
        found = materialize(_turn(queries, index, cells, start, stop, k, limit), "found")
        seen = found.groupBy("query_id", "query_row").agg(F.sum("verified").alias("verified"))
        verified = seen if verified is None else verified.union(seen)
        hits = found.where("row IS NOT NULL").drop("verified")
        hits = hits if best is None else best.drop("rank").union(hits)
        w = Window.partitionBy("query_row").orderBy("d", "vec_id", "row")  # k rows for each part of a cell at most
        best = materialize(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
        full = best.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("d").alias("bound"))
        queries = asked.join(full, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return best.select("query_id", "rank", "vec_id", F.sqrt("d").alias("score")), verified.groupBy("query_id", "query_row").agg(F.sum("verified").alias("verified"))


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, confidence: float = 0.95, seed: int = 11) -> DataFrame:
    """The k nearest vectors of each query, a row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance in double precision),
    nearest first, ties to the smaller vec_id. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows with a null id; vectors of different
    lengths do not meet. A row repeating an id is one more candidate, so an id can come twice; one
    repeating a query's id is one more query with k rows of its own, which finds the other. An empty table gives
    an empty one.

    ``confidence`` is that of the chi-square test: each of the k nearest is found with this probability at least, and
    a query with k vectors or fewer to find verifies all.
    """
    return search_index(embeddings, every, k, confidence, seed)[0]
