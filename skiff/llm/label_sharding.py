"""Sharding by balanced label propagation, under the law that shard sizes in rows differ by one at most.

Documents with equal texts are linked, through one hub for each text. A document starts in the shard that the
hash of its id gives, by rank, so all shards are full and the start knows nothing of the texts. Each round joins
documents with their hub's counts, finds the shard where most of the linked documents are, and wishes to
move there. For each pair of shards as many documents move one way as the other, so quotas
hold after every move: wishes with the largest gain go first, and documents without links, which
lose nothing, fill the way back. Rounds end when no wish can be met. Groups that no shard can hold come last:
their documents fill the way back of the others first, and then gather themselves.

A move goes to a shard with at least as many documents of the hub as the one it leaves, so the sum of the squares
of these counts grows in every round, and the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import materialize, rank_in_class


def propagate(documents: DataFrame, shards: int = 8) -> tuple[DataFrame, list[dict[str, int]]]:
    """(placed documents, rounds): key, doc_id, size, text_crc32, hub and shard; what each round found and did.

    A round counts ``cut`` (linked documents that are not in the shard of most of their hub's, before it) and
    ``moved`` (documents that changed their shard in it, those that fill the way back included). The last
    round moves nothing. Where there are groups that no shard can hold, their rounds follow.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("hub")
    )
    # Equal documents are told apart by their number, from one range sort.
    rows = rows.withColumn("_mix", F.xxhash64("doc_id")).withColumn("_all", F.lit(0))
    rows = rank_in_class(rows, ["_all"], ["_mix", "doc_id", "text_crc32", "size"], "key").drop("_all", "_mix")
    total = rows.count()
    # Contiguous stretches of the order of hashes: counts differ by one at most from the start.
    small, extra = divmod(total, shards)
    shard = F.when(F.col("key") < extra * (small + 1), F.floor(F.col("key") / (small + 1))).otherwise(
        F.lit(extra) + F.floor((F.col("key") - extra * (small + 1)) / max(1, small))
    )
    state = materialize(rows.withColumn("shard", shard.cast("int")), "shards")
    linked = materialize(state.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    large = materialize(linked.where(F.col("n") > small).select("hub"), "large")  # a few times ``shards`` at most
    members = materialize(state.join(linked.where(F.col("n") <= small), "hub", "left_semi").select("key", "hub", "shard"), "members")
    others = state.join(linked.where(F.col("n") <= small), "hub", "left_anti").select("key", "hub", "shard")
    members, others, history = settle(members, others, shards)
    if not large.isEmpty():
        others = materialize(others, "others")
        giants = materialize(others.join(F.broadcast(large), "hub", "left_semi"), "giants")
        giants, others, more = settle(giants, others.join(F.broadcast(large), "hub", "left_anti"), shards)
        members, history = members.union(giants), history + more
    placed = members.union(others).select("key", "shard")
    return state.drop("shard").join(placed, "key"), history


def settle(members: DataFrame, others: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, list[dict[str, int]]]:
    """Rounds until no wish of ``members`` can be met, ``others`` filling the way back; both are (key, hub, shard)."""
    single = rank_in_class(others.select("key", "hub", "shard"), ["shard"], ["key"], "place")
    free = {r["shard"]: r["n"] for r in single.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    used, bands, history = dict.fromkeys(range(shards), 0), [], []
    while True:
        members, back, done = _round(members, {s: free.get(s, 0) - used[s] for s in used})
        history.append(done)
        if not done["moved"]:
            break
        # Documents without links go back in order of their place, each once; a few stretches for each round.
        for (f, t), n in sorted(back.items()):
            bands.append((f, t, used[f], used[f] + n))
            used[f] += n
    if bands:
        low = members.sparkSession.createDataFrame(bands, "home int, `to` int, low long, high long")
        hit = (F.col("shard") == F.col("home")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
        single = single.join(F.broadcast(low), hit, "left").withColumn("shard", F.coalesce("to", "shard"))
    return members, single.select("key", "hub", "shard"), history


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Put all documents into shards 0 to ``shards`` - 1, equal texts together where quotas allow.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('rows': counts differ by one at most),
    shard, slot (gapless from 0 in each shard) and grown_shard (null under this law), a row for each
    row of ``documents``. A null text counts as empty; null texts and empty ones are equal texts.
    Repeated rows are documents of their own; null ids are allowed; other columns are ignored. A
    group larger than a shard spreads over several, since quotas come first; where shards tie for the most of a
    group, a hash of the group and the shard decides, so that wishes spread. An empty table gives an empty one.
    """
    placed, _ = propagate(documents, shards)
    out = rank_in_class(placed.drop("hub"), ["shard"], ["key"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _round(members: DataFrame, free: dict[int, int]) -> tuple[DataFrame, dict[tuple[int, int], int], dict[str, int]]:
    """(members after it, documents without links that have to move (from, to), counts) of one exchange between shards."""
    votes = members.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("hub").agg(F.max(F.struct("c", F.xxhash64("hub", "shard").alias("h"), "shard")).alias("top")).select("hub", F.col("top.c").alias("most"), F.col("top.shard").alias("to"))
    wish = votes.join(best, "hub").where(F.col("shard") != F.col("to")).select("hub", "shard", "to", (F.col("c") - F.col("most")).alias("loss"))
    # Written before the join, so that Spark can split a hot hub in it.
    wish = materialize(wish, "wishes")
    wanted = members.join(wish, ["hub", "shard"]).select("key", F.col("shard").alias("from"), "to", "loss")
    ranked = rank_in_class(wanted, ["from", "to"], ["loss", "key"], "place")
    # At most shards * shards rows, whatever the corpus.
    flow = {(r["from"], r["to"]): r["n"] for r in ranked.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
    allow, back = _quotas(flow, free)
    done = {"cut": sum(flow.values()), "moved": sum(allow.values()) + sum(back.values())}
    if not done["moved"]:
        return members, back, done
    limits = members.sparkSession.createDataFrame([(f, t, n) for (f, t), n in allow.items()], "`from` int, `to` int, allowed long")
    going = ranked.join(F.broadcast(limits), ["from", "to"]).where("place < allowed").select("key", "to")
    moved = members.join(going, "key", "left").select("key", "hub", F.coalesce("to", "shard").alias("shard"))
    return materialize(moved, "members"), back, done


def _quotas(flow: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict, dict]:
    """(moves allowed for each wish (from, to), documents without links that move (from, to)) such that no count changes."""
    allow, back = {}, {}
    left = dict(free)
    for (i, j), n in sorted(flow.items(), key=lambda x: (-x[1], x[0])):
        swap = min(n, flow.get((j, i), 0))  # wishes both ways
        fill = min(n - swap, left.get(j, 0))  # documents of j without links make room
        allow[i, j] = swap + fill
        if fill:
            left[j] -= fill
            back[j, i] = fill
    return allow, back
