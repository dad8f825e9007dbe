"""Sharding by balanced label propagation, with row counts of shards at most one apart.

Documents that share a link key (for instance equal texts) are linked. They start in the shard of their
id's hash; each round counts every key's documents by shard, and each document prefers the shard where most
of its neighbours are. How many may move from one shard to another is settled from the table of wishes
(shards x shards x size classes of the gain): large gains first, and no shard beyond its quota. At the end
documents without links fill the shards up, exactly; only what exceeds a quota then moves once more.

Links stay stars around their keys, never pairs. A key's counts are one row, kept as a table, so that Spark
may split the rows of a frequent key. Row numbers come from counts of a fixed number of hash buckets and
ranks inside them, so that no task sees a shard whole.

Defined results: a null text is empty and of size 1; null and repeated doc_ids and repeated rows are rows of
their own; fewer documents than shards leave some shards empty; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeingest.llm.common import drop_stored, stored, text_of

SHARDS, ROUNDS, BUCKETS = 8, 4, 4096


def equal_texts(text: Column) -> list[Column]:
    """The link key of documents with equal texts."""
    return [F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))]


def settle(wishes: dict[tuple[int, int, int], int], held: np.ndarray, quota: np.ndarray) -> dict[tuple[int, int, int], int]:
    """How many of each wish ``(from, to, gain class)`` come true so that no shard ends above its quota.

    A shard that would end above it turns away the smallest gains; that leaves more in other shards, so the
    pass is repeated until nothing is turned away. A shard above its quota from the start takes none in.
    """
    granted = dict(wishes)
    while True:
        after = held.astype(np.int64).copy()
        for (a, b, _), n in granted.items():
            after[a] -= n
            after[b] += n
        turned = False
        for shard in np.flatnonzero(after > quota):
            excess = int(after[shard] - quota[shard])
            for wish in sorted((w for w in granted if w[1] == shard and granted[w]), key=lambda w: (w[2], w[0])):
                back = min(excess, granted[wish])
                granted[wish] -= back
                excess -= back
                turned = turned or back > 0
        if not turned:
            return granted


def propagate(links: DataFrame, start: DataFrame, quota: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """``(uid, shard)`` after the rounds. ``links (uid, key)``, ``start (uid, shard)`` for every linked uid."""
    spark, shards = links.sparkSession, len(quota)
    state, folder = stored(start, "labels")
    for turn in range(rounds):
        held = np.zeros(shards, np.int64)
        for r in state.groupBy("shard").count().collect():
            held[r["shard"]] = r["count"]
        room = F.array(*[F.lit(bool(x)) for x in held < quota])
        at = links.join(state, "uid")
        counts, counts_folder = stored(at.groupBy("key").agg(
            F.array(*[F.sum((F.col("shard") == s).cast("bigint")) for s in range(shards)]).alias("n")), "key-counts")
        votes = at.join(counts, "key").groupBy("uid", "shard").agg(
            F.array(*[F.sum(F.col("n")[s]) for s in range(shards)]).alias("n"), F.min(F.pmod(F.xxhash64("key"), F.lit(shards))).alias("turn"))
        # Ties go to one shard for all neighbours, else two of them would swap places for ever: one with room, and
        # of several the one that the key says.
        rank = F.transform("n", lambda v, s: F.struct(v.alias("votes"), F.get(room, s).alias("room"), (-F.pmod(s + F.col("turn"), F.lit(shards))).alias("first"), s.alias("shard")))
        best = F.array_max(rank)
        wishes = votes.select("uid", "shard", best["shard"].cast("int").alias("wish"), (best["votes"] - F.col("n")[F.col("shard")]).alias("gain"))
        wishes, wishes_folder = stored(wishes.withColumn("size", F.floor(F.log2(F.col("gain") + 1)).cast("int")), "wishes")
        asked = {(r["shard"], r["wish"], r["size"]): r["count"] for r in wishes.where("shard <> wish").groupBy("shard", "wish", "size").count().collect()}
        granted = settle(asked, held, quota)
        if not any(granted.values()):
            drop_stored(spark, counts_folder), drop_stored(spark, wishes_folder)
            break
        share = F.lit(0.0)
        for (a, b, size), n in granted.items():
            share = F.when((F.col("shard") == a) & (F.col("wish") == b) & (F.col("size") == size), n / asked[a, b, size]).otherwise(share)
        lot = F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(1 << 30)) / float(1 << 30)
        moved, fresh = stored(wishes.select("uid", F.when(lot < share, F.col("wish")).otherwise(F.col("shard")).alias("shard")), "labels")
        for gone in (folder, counts_folder, wishes_folder):
            drop_stored(spark, gone)
        state, folder = moved, fresh
    return state


def numbered(df: DataFrame, part: str, uid: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``number``: gapless from 0 within each value of ``part``."""
    spread = df.withColumn("lp_bucket", F.pmod(F.xxhash64(F.lit(7), uid), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(part, "lp_bucket").agg(F.count(F.lit(1)).alias("n"))  # parts x buckets rows at most
    before = W.partitionBy(part).orderBy("lp_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(part, "lp_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lp_before"))
    rank = F.row_number().over(W.partitionBy(part, "lp_bucket").orderBy(uid))
    return spread.join(offsets, [part, "lp_bucket"]).withColumn("number", F.col("lp_before") + rank - 1).drop("lp_bucket", "lp_before")


def _of(values, part: Column) -> Column:
    """A value per shard, as an expression."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), part + 1)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, keys=equal_texts) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row under the law ``rows``."""
    text = F.col("text")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.array(*keys(text)).alias("keys"))
    base, _ = stored(base, "sized")  # fixes the uids
    member = base.select("uid", "doc_id", F.explode("keys").alias("key"))
    shared, _ = stored(member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    linked, _ = stored(member.join(shared, "key"), "linked")
    total = base.count()
    target = np.array([total // shards + (s < total % shards) for s in range(shards)])
    first = F.pmod(F.xxhash64("doc_id", "uid"), F.lit(shards)).cast("int")
    start = linked.select("uid", "doc_id").distinct().select("uid", first.alias("shard"))
    state = propagate(linked.select("uid", "key"), start, target, rounds)

    # Part ``shards`` holds the documents without links.
    placed = base.drop("keys").join(state, "uid", "left").withColumn("part", F.coalesce("shard", F.lit(shards))).drop("shard")
    held = np.zeros(shards + 1, np.int64)
    for r in placed.groupBy("part").count().collect():
        held[r["part"]] = r["count"]
    stay = np.minimum(held[:shards], target)
    over = held[:shards] - stay
    room = np.cumsum(target - stay)  # the pool of the unlinked, then of those beyond a quota, fills shard by shard
    rows = numbered(placed, "part", "uid")
    part, number = F.col("part"), F.col("number")
    stays = (part < shards) & (number < _of([*stay, 0], part))
    pool = F.when(part == shards, number).otherwise(
        held[shards].item() + _of([*(np.cumsum(over) - over), 0], part) + number - _of([*stay, 0], part))
    rows = rows.withColumn("pool", pool).withColumn("stays", stays)
    into = sum((F.col("pool") >= int(edge)).cast("int") for edge in room)
    rows = rows.withColumn("shard", F.when(F.col("stays"), part).otherwise(into).cast("int"))
    slot = F.when(F.col("stays"), number).otherwise(_of(stay, F.col("shard")) + F.col("pool") - _of(np.concatenate([[0], room[:-1]]), F.col("shard")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("bigint").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))
