"""Balanced label propagation: documents into shards, linked documents together (DataFrame functions only).

Documents of equal text are linked, by a star over their text key.  Every document
starts at the shard of its hash.  In each round a group of linked documents counts
its members' shards and wants the one most of them are in and that has room; a
shard takes groups, in a fixed order, while its quota lasts, and groups turned
down count again among the shards that still have room.  What stays open after
the last round, groups larger than a part of a quota among it, is laid out side by
side over the room left, so that a group is cut only where a shard is full.
Quotas are row counts at most one apart (law `rows`), which the result keeps exactly.

All running totals have two levels (a bounded table of bucket totals, then rows
within a bucket), so no task holds a shard, a group or the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved

#: Buckets of the two-level running totals; the bounded tables have this many rows per shard.
BUCKETS = 1024
#: Parts a group that is laid out row by row is dealt to.
SALTS = 64
_G = ["g1", "g2"]


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def _totals(rows: DataFrame, keys: list[str], bucket: str, value: Column, name: str = "base") -> DataFrame:
    """(keys, bucket, base): the sum of `value` in the buckets before this one. Bounded by keys x BUCKETS rows."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))


def _pick(room: list[int], seed: Column) -> Column:
    """A shard with room, by hash."""
    open_ = [s for s, r in enumerate(room) if r > 0]
    return F.element_at(F.array(*[F.lit(s) for s in open_]), (F.pmod(seed, F.lit(len(open_))) + 1).cast("int"))


def assign(docs: DataFrame, shards: int = 16, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of `docs`.

    size is the UTF-8 bytes of the text plus 1 (null: 1); text_crc32 that of the
    text (null as empty).  Row counts of shards differ by one at most; slots are
    gapless from 0 in each shard.  Null texts are one group, empty ones another;
    repeated rows are placed one by one; ties go by text hash and doc_id; a very long
    text counts its size only; columns other than doc_id and text, whatever their
    names, are not read; an empty table gives no rows.
    """
    text = F.col("text")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), F.length(text), F.crc32(text.cast("binary"))).alias("g2"),
    ).withColumn("start", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(shards)).cast("int"))
    slim = saved(slim, "shard-rows")
    units = slim.groupBy(*_G, "start").agg(F.count(F.lit(1)).alias("n"))
    total = slim.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    groups = units.groupBy(*_G).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("start").alias("s")))).alias("at"))
    groups = saved(groups.filter("n > 1"), "shard-groups")  # a group's list has `shards` entries at most
    most = max(1, total // shards // 8)
    waiting, placed = groups.filter(F.col("n") <= most), None
    for turn in range(rounds):
        if not any(r > 0 for r in room):
            break
        free = F.array(*[F.lit(s) for s, r in enumerate(room) if r > 0])
        liked = F.transform(F.filter("at", lambda x: F.array_contains(free, x["s"])), lambda x: x["s"])  # shards with room, most members first
        want = F.coalesce(F.try_element_at(liked, F.lit(1 + turn)), F.try_element_at(liked, F.lit(1)), _pick(room, F.col("g1")))
        asked = waiting.withColumn("label", want).withColumn("b", _bucket(*_G))
        base = _totals(asked, ["label"], "b", F.col("n"))
        within = F.sum("n").over(Window.partitionBy("label", "b").orderBy(*_G))
        limit = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("label") + 1)
        asked = asked.join(F.broadcast(base), ["label", "b"]).withColumn("ok", F.col("base") + within <= limit)
        asked = saved(asked.select(*_G, "n", "at", "label", "ok"), "shard-round")
        took = {r["label"]: r["n"] for r in asked.filter("ok").groupBy("label").agg(F.sum("n").alias("n")).collect()}
        room = [r - took.get(s, 0) for s, r in enumerate(room)]
        now = asked.filter("ok").select(*_G, "label")
        placed = now if placed is None else placed.unionByName(now)
        waiting = asked.filter("NOT ok").select(*_G, "n", "at")
        if waiting.isEmpty():
            break
    known = groups.filter(F.col("n") <= most).select(*_G, F.lit(True).alias("linked"))
    if placed is not None:
        known = known.join(placed, _G, "left")
    else:
        known = known.withColumn("label", F.lit(None).cast("int"))
    large = groups.filter(F.col("n") > most).select(*_G, F.lit(True).alias("large"))  # at most 8 groups a shard
    slim = slim.join(F.broadcast(large), _G, "left")
    few = slim.filter(F.col("large").isNull()).join(known, _G, "left")
    many = slim.filter("large").withColumn("linked", F.lit(True)).withColumn("label", F.lit(None).cast("int"))
    rows = saved(few.unionByName(many).drop("large"), "shard-known")
    rest = (
        rows.filter(F.col("label").isNull())
        .withColumn("tier", F.when(F.col("linked"), 0).otherwise(1))
        .withColumn("b", F.when(F.col("linked"), _bucket(*_G)).otherwise(_bucket("doc_id", "g1")))
        .withColumn("u1", F.when(F.col("linked"), F.col("g1")).otherwise(F.lit(0).cast("long")))
        .withColumn("u2", F.when(F.col("linked"), F.col("g2")).otherwise(F.lit(0).cast("long")))
        .withColumn("salt", F.when(F.col("linked"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
        .withColumn("tb", F.col("tier") * BUCKETS + F.col("b"))
    )
    unit = ["tb", "u1", "u2", "salt"]
    sums = rest.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
    base = _totals(sums.withColumn("all", F.lit(0)), ["all"], "tb", F.col("n")).drop("all")
    before = F.sum("n").over(Window.partitionBy("tb").orderBy("u1", "u2", "salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("inner", F.coalesce(before, F.lit(0))).join(F.broadcast(base), "tb").select(*unit, (F.col("base") + F.col("inner")).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy(*unit).orderBy("doc_id", "g1", "g2")) - 1
    edges, upto = [], 0
    for s, r in enumerate(room):
        upto += r
        edges.append((upto, s))
    shard = F.lit(shards - 1)
    for upto, s in reversed(edges):
        shard = F.when(F.col("rank") < upto, s).otherwise(shard)
    laid = rest.join(sums, unit).withColumn("rank", rank).select("doc_id", "size", "text_crc32", "g1", shard.alias("shard"))
    kept = rows.filter(F.col("label").isNotNull()).select("doc_id", "size", "text_crc32", "g1", F.col("label").alias("shard"))
    out = saved(laid.unionByName(kept).withColumn("b", _bucket("doc_id")), "shard-out")
    base = _totals(out.withColumn("_one", F.lit(1)), ["shard"], "b", F.col("_one"))
    place = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "g1")) - 1
    return out.join(F.broadcast(base), ["shard", "b"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + place).cast("long").alias("slot"))
