"""Sharding: balanced label propagation over linked documents, with DataFrame functions only.

Copies of a text are linked. They are gathered into *cells* of bounded size (part of a group, by a hash of the id), the vertices
of the graph; a small group is one cell. Rounds of joins move cells towards the shard in which most of their group lies, as far
as the shard's quota of free rows goes; who may move is decided by a priority hash and a histogram of at most shards * BUCKETS
rows. Finally all rows are ranked within their shard, first those of large groups, then of small ones, then the unlinked, and the
surplus of shards that are over their share fills the places that others lack, in order: counts end at most one apart, what moves
are unlinked rows first, and a small group that has to move does so as a whole but for the ends of a shard's gap.

Ranks come from counts of small hash buckets, so no shard is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import Scratch, sized

#: Priority classes of a round's moves.
BUCKETS = 1024
#: Rows that are ranked together, and buckets of so many rows whose sizes are summed up together.
RANKED, RANGE = 500, 4096


def propagate(spark: SparkSession, scratch: Scratch, cells: DataFrame, shards: int, quota: int, rounds: int = 10) -> DataFrame:
    """Shards of linked cells. ``cells``: group, cell, weight; returns cell, shard, for groups of several cells.

    Per round, only cells of one hash parity may move, so neighbours don't swap places.
    """
    several = cells.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").select("group")
    largest = cells.agg(F.max("weight")).first()[0] or 0  # a shard takes part while it has room for any cell
    state = scratch.write(cells.join(several, "group", "left_semi").withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)).cast("int")), "labels-0")
    idle = 0
    for i in range(1, rounds + 1):
        load = {r["shard"]: r["w"] for r in state.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
        free = {s: quota - load.get(s, 0) for s in range(shards)}
        room = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, free[s])]), F.col("shard"))
        votes = state.groupBy("group", "shard").agg(F.sum("weight").alias("votes")).withColumn("open", room >= largest)
        # of a group's open shards (as many as there are shards at most) the fullest, as many as its rows there fill
        opened = F.sort_array(F.collect_list(F.when(F.col("open"), F.struct("votes", (-F.col("shard")).alias("s")))), asc=False)
        fills = F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("open"), F.col("votes"))) / max(1, quota))).cast("int")
        best = votes.groupBy("group").agg(opened.alias("opened"), fills.alias("k")).select("group", F.slice("opened", 1, F.least(F.size("opened"), F.col("k"))).alias("targets")).where(F.size("targets") > 0)
        pick = F.element_at("targets", (F.pmod(F.xxhash64("cell", F.lit(3)), F.size("targets")) + 1).cast("int"))
        seen = state.join(best, "group", "left").join(votes.select("group", "shard", "votes"), ["group", "shard"]).withColumn("pick", F.when(F.col("targets").isNotNull(), pick))
        seen = seen.withColumn("to", -F.col("pick.s")).withColumn("best", F.col("pick.votes"))
        settled = F.array_contains(F.transform("targets", lambda t: -t["s"]), F.col("shard"))
        wants = ~settled & ((F.col("best") > F.col("votes")) | (F.col("best") == F.col("votes")) & (F.col("to") < F.col("shard")))
        seen = seen.withColumn("bucket", F.when(wants & (F.pmod(F.xxhash64("cell", F.lit(7)) + i, F.lit(2)) == 0), F.pmod(F.xxhash64(F.lit(i), "cell"), F.lit(BUCKETS)).cast("int")))
        asked = seen.where("bucket is not null").groupBy("to", "bucket").agg(F.sum("weight").alias("w")).collect()
        cut = dict.fromkeys(range(shards), 0)
        for s in range(shards):
            left = free[s]
            for r in sorted((r for r in asked if r["to"] == s), key=lambda r: r["bucket"]):
                if (left := left - r["w"]) < 0:
                    break
                cut[s] = r["bucket"] + 1
        if not asked:
            if (idle := idle + 1) == 2:  # neither parity wants to move
                break
            continue
        idle = 0
        goes = F.coalesce(F.col("bucket") < F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, cut[s])]), F.col("to")), F.lit(False))
        state = scratch.write(seen.select("group", "cell", "weight", F.when(goes, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")), f"labels-{i}")
    return state.select("cell", "shard")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24, rounds: int = 10) -> DataFrame:
    """Put all ``docs`` (doc_id, text) into ``shards`` shards under the law ``rows``: counts differ by one at most.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (gapless from 0 in each
    shard) and grown_shard (null). Documents of one text are kept together as far as the law allows.

    Edge cases: a null text has 0 bytes and crc32 0 and is linked with empty ones; rows with a null or repeated doc_id are rows like any
    other; with fewer rows than shards the last shards stay empty; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    base = scratch.write(base.select("doc_id", "bytes", "crc", F.xxhash64("h", "crc", "bytes").alias("group")), "rows")
    groups = base.groupBy("group").agg(F.count("*").alias("n"))
    stats = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("linked")).first()
    total, most = stats["rows"], max(1, min(2000, stats["rows"] // (shards * 32)))
    linked = groups.where("n > 1").select("group", F.ceil(F.col("n") / most).cast("long").alias("parts"))
    rows = base.join(sized(linked, stats["linked"]), "group", "left")
    rows = scratch.write(rows.withColumn("cell", F.xxhash64("group", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))))), "cells")
    cells = rows.where("parts is not null").groupBy("group", "cell").agg(F.count("*").alias("weight"))
    labels = scratch.write(propagate(spark, scratch, cells, shards, total // shards, rounds), "labels")
    placed = rows.join(sized(labels), "cell", "left").select("doc_id", "bytes", "crc", F.coalesce("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)).cast("int")).alias("shard"), F.when(F.col("shard").isNotNull(), 0).when(F.col("parts").isNotNull(), 1).otherwise(2).alias("class"), "cell")
    wide = max(1, total // (shards * RANKED))
    spread = F.when(F.col("class") == 2, F.xxhash64("cell", "doc_id")).otherwise(F.xxhash64("cell"))
    placed = scratch.write(placed.withColumn("bucket", F.pmod(spread, F.lit(wide))), "placed")
    counts = placed.groupBy("shard", "class", "bucket").agg(F.count("*").alias("n"))
    # prefix sums in two levels: over ranges of buckets in a shard, and over the buckets of a range
    earlier = lambda rows, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*rows).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.write(counts.withColumn("range", F.floor(F.col("bucket") / RANGE)), "counts")
    ranges = counts.groupBy("shard", "class", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("shard", "class", "range", earlier(["shard"], "class", "range").alias("sum"))
    offsets = counts.withColumn("inside", earlier(["shard", "class", "range"], "bucket")).join(ranges, ["shard", "class", "range"])
    offsets = scratch.write(offsets.select("shard", "class", "bucket", "n", (F.col("sum") + F.col("inside")).alias("before")), "offsets")
    inside = F.row_number().over(Window.partitionBy("shard", "class", "bucket").orderBy("cell", "doc_id")) - 1
    ranked = placed.withColumn("inside", inside).join(sized(offsets.drop("n")), ["shard", "class", "bucket"]).withColumn("place", F.col("before") + F.col("inside"))
    held = {r["shard"]: r["n"] for r in offsets.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    share = [total // shards + (s < total % shards) for s in range(shards)]
    over, lack, target, slot, at = {}, 0, F.lit(None), F.lit(None), 0
    for s in range(shards):
        over[s] = at
        at += max(0, held.get(s, 0) - share[s])
    extra = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, over[s] - share[s])]), F.col("shard")) + F.col("place")
    stays = F.col("place") < F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, share[s])]), F.col("shard"))
    for s in range(shards):
        if (gap := share[s] - held.get(s, 0)) > 0:
            hit = (extra >= lack) & (extra < lack + gap)
            target, slot, lack = F.when(hit, s).otherwise(target), F.when(hit, extra - lack + held.get(s, 0)).otherwise(slot), lack + gap
    return ranked.select(
        "doc_id", (F.col("bytes") + 8).alias("size"), F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.when(stays, F.col("shard")).otherwise(target).cast("int").alias("shard"),
        F.when(stays, F.col("place")).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
