"""Balanced label propagation onto shards.

Documents of equal text are linked.  They start on shards by a hash of their
id, and iterations of Spark joins move them to the shard that holds most of
their group, under quotas that keep the shards' row counts even: the law is
``rows``, counts at most one apart.

The graph is kept in cells: the documents of one group that start on the same
shard move together.  In each iteration a cell asks for the shard where its
group is strongest (a group larger than a quota: for several shards).  A
shard's room is what its quota leaves beside the linked documents that it
holds, as unlinked ones can always give way; it takes what fits into its room
and what leaves it.  If more asks, a hash of group and shard decides, the same
for all cells of a group.  At last rows beyond a shard's quota, unlinked ones
first, fill the gaps of the others, in an order given by prefix sums over
buckets, so that no shard is ever ranked in one task.

All of it is DataFrame and SQL functions; no step sees more than one bucket or
one group's cells (at most as many as shards) together.

Edge cases: null text has size 8 and crc32 0 and is linked with nothing; the
empty text is a text like any other; a null doc_id starts on a hash of its own;
repeated rows are separate rows of one group; fewer rows than shards leave
shards empty; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, maybe_broadcast, staged

SHARDS = 24
ROUNDS = 8
BUCKET_ROWS = 20_000        # rows ranked in one task, about


def table_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, group (null if no other row has
    the text), the shard at the start, and a hash that orders rows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.unhex(F.md5("text")).alias("g"))
    rows = staged(rows, "shard-rows")
    linked = staged(rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.lit(True).alias("linked")), "shard-groups")
    # the groups are a written table, so that Spark can split a hot one in a shuffled join
    rows = rows.join(maybe_broadcast(linked, linked.count()), "g", "left")
    return staged(rows.select(
        "doc_id", "size", "text_crc32", F.when(F.col("linked"), F.col("g")).alias("g"),
        F.pmod(F.xxhash64(F.lit("start"), "doc_id", "g"), F.lit(shards)).cast("int").alias("start"),
        F.xxhash64(F.lit("order"), "doc_id", "g", "text_crc32").alias("h")), "shard-table")


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def shares(flow: dict, room: list[int]) -> list[float]:
    """For each shard the share of the rows asking for it that it can take:
    what comes in may not exceed its room and what goes out.  ``flow`` has the
    rows that ask, by (from, to): at most shards squared numbers."""
    n = len(room)
    share = [1.0] * n
    for _ in range(200):
        for t in range(n):
            come = share[t] * sum(flow.get((s, t), 0) for s in range(n))
            go = sum(share[u] * flow.get((t, u), 0) for u in range(n))
            if come > max(0, room[t] + go):
                share[t] *= max(0, room[t] + go) / come
    return share


def _pick(values, col) -> Column:
    """The value that belongs to a shard number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), col + 1)


def propagate(rows: DataFrame, quota: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(g, start, shard) of every cell, and the cut links before each
    iteration: a group's documents outside the shard that holds most of it."""
    cells = staged(rows.where("g is not null").groupBy("g", "start").agg(F.count("*").alias("c")).withColumn("shard", F.col("start")), "shard-cells")
    cuts = []
    for r in range(rounds):
        held = staged(cells.groupBy("g", "shard").agg(F.sum("c").alias("here")), "shard-held")
        per = {x["shard"]: x["n"] for x in held.groupBy("shard").agg(F.sum("here").alias("n")).collect()}
        total, kept = held.groupBy("g").agg(F.sum("here").alias("t"), F.max("here").alias("m")).agg(F.sum("t"), F.sum("m")).first()
        cuts.append((total or 0) - (kept or 0))
        room = [q - per.get(s, 0) for s, q in enumerate(quota)]
        open_ = F.lit(True) if r % 2 == 0 else _pick([x > 0 for x in room], F.col("shard"))
        # a group's shards, strongest first; a hash that changes with the round
        # breaks ties, so that groups spread.  At most as many as there are shards.
        luck = F.pmod(F.xxhash64(F.lit(r), "g", "shard"), F.lit(1 << 20))
        likes = (held.where(open_).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("here", luck.alias("t"), "shard")), asc=False).alias("to")))
        # a group larger than a quota takes several shards, each up to its quota
        own = Window.partitionBy("g").orderBy("rank", "start").rowsBetween(Window.unboundedPreceding, -1)
        asks = (cells.join(likes, "g").withColumn("rank", F.array_position(F.col("to.shard"), F.col("shard")))
                .withColumn("rank", F.when(F.col("rank") == 0, len(quota) + 1).otherwise(F.col("rank")))
                .withColumn("before", F.coalesce(F.sum("c").over(own), F.lit(0)))
                .withColumn("to", F.try_element_at(F.col("to.shard"), (F.floor(F.col("before") / max(1, max(quota))) + 1).cast("int")))
                .where("to is not null and to <> shard"))
        asks = staged(asks.select("g", "start", "shard", "to", "c"), "shard-asks")
        flow = {(x["shard"], x["to"]): x["n"] for x in asks.groupBy("shard", "to").agg(F.sum("c").alias("n")).collect()}
        share = shares(flow, room)
        chance = F.pmod(F.xxhash64(F.lit(~r), "g", "to"), F.lit(1 << 20)) / float(1 << 20)
        moves = asks.where(chance < _pick(share, F.col("to"))).select("g", "start", "to")
        new = staged(cells.join(moves, ["g", "start"], "left").select("g", "start", "c", F.coalesce("to", "shard").alias("shard")), "shard-cells")
        for old in (cells, held, asks):
            drop_staged(old)
        cells = new
        if not flow:
            break
    return cells.select("g", "start", "shard"), cuts


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """Rank (from 0) of each row within its shard: linked rows first, groups
    together in a hash order.  Buckets of that order, cut further where a hot
    group fills one, are ranked apart and placed by the sums of the buckets
    before them; of equal rows any order will do."""
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("free", F.col("g").isNull().cast("int"))
    rows = rows.withColumn("order", F.when(F.col("free") == 1, F.col("h")).otherwise(F.xxhash64(F.lit("group"), "g")))
    rows = rows.withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)))
    cut = ["shard", "free", "bucket"]
    parts = staged(rows.groupBy(*cut).agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("parts")), "shard-parts")
    rows = rows.join(maybe_broadcast(parts, parts.count()), cut).withColumn("part", F.pmod(F.col("h"), F.col("parts"))).drop("parts")
    cut.append("part")
    counts = staged(rows.groupBy(*cut).agg(F.count("*").alias("n")), "shard-buckets")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("free", "bucket", "part")) - F.col("n")
    places = counts.select(*cut, before.alias("base"))
    own = F.row_number().over(Window.partitionBy(*cut).orderBy("order", "h", "doc_id"))
    return (rows.withColumn("own", own).join(maybe_broadcast(places, counts.count()), cut)
            .withColumn("rank", F.col("base") + F.col("own") - 1).select("doc_id", "size", "text_crc32", "shard", "rank"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = table_of(docs, shards)
    n = rows.count()
    quota = quotas(n, shards)
    cells, _ = propagate(rows, quota, rounds)
    cells = staged(cells, "shard-places")
    placed = rows.alias("r").join(maybe_broadcast(cells.alias("c"), cells.count()),
                                  (F.col("r.g") == F.col("c.g")) & (F.col("r.start") == F.col("c.start")), "left")
    placed = placed.select("r.doc_id", "r.size", "r.text_crc32", "r.g", "r.h", F.coalesce("c.shard", "r.start").alias("shard"))
    order = staged(ranked(placed, n), "shard-ranks")
    have = {x["shard"]: x["n"] for x in order.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over, gaps, a, b = [], [], 0, 0         # where each shard's surplus, and its gap, begins
    for s, q in enumerate(quota):
        over.append(a)
        a += max(0, have.get(s, 0) - q)
        gaps.append(b)
        b += max(0, q - have.get(s, 0))
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("shard") + 1)
    k = at(over) + F.col("rank") - at(quota)
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, q in enumerate(quota):
        room = max(0, q - have.get(s, 0))
        if room:
            inside = (F.col("k") >= gaps[s]) & (F.col("k") < gaps[s] + room)
            shard = F.when(inside, F.lit(s)).otherwise(shard)
            slot = F.when(inside, F.col("k") - gaps[s] + have.get(s, 0)).otherwise(slot)
    out = order.withColumn("k", F.when(F.col("rank") >= at(quota), k))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                      F.when(F.col("k").isNull(), F.col("shard")).otherwise(shard).cast("int").alias("shard"),
                      F.when(F.col("k").isNull(), F.col("rank")).otherwise(slot).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
