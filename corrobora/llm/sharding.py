"""Shards through fixed virtual slots.

A record's slot is a hash of its id (of its text where the id is null), so it never changes. What changes is the versioned map from
slots to shards: the first version deals the slots evenly by number, every further version is an
edit of the one before it, made from the bytes counted per slot. Only slots leave a shard that
holds more than its share, so a rebalance moves few records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stage, text_of

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS, text: Column | None = None) -> Column:
    """Virtual slot of a key; a null key has the slot of its text's digest, so that rows without ids are spread too."""
    instead = F.lit("") if text is None else F.sha2(text, 256)
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), instead)), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, rows, bytes for every slot, empty ones too: at most ``slots`` rows, summed before the shuffle."""
    counted = records.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(counted, "virtual_slot", "left").na.fill(0, ["rows", "bytes"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round by number, whatever they hold."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int, keep: float = 0.9) -> DataFrame:
    """The next version of the map, edited so that the shards' bytes are near equal.

    Each shard keeps its slots, largest first, up to ``keep`` of an equal share. The others are
    dealt largest first, each to the shard with the fewest bytes at that moment. Both tables have
    one row per slot, a fixed number, and the fold that deals them is one row with two arrays.
    """
    latest = slot_map.agg(F.max("version").alias("latest"))
    now = slot_map.join(F.broadcast(latest), F.col("version") == F.col("latest")).join(sizes, "virtual_slot")
    total = F.sum("bytes").over(Window.partitionBy("version"))
    upto = F.sum("bytes").over(
        Window.partitionBy("version", "shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    stays = (F.col("shard") < shards) & (upto <= total * keep / shards)
    placed = now.withColumn("stays", stays)
    held = F.struct(F.col("bytes").cast("bigint").alias("bytes"), F.col("virtual_slot"), F.col("shard"), F.col("stays"))
    one = placed.groupBy("version").agg(F.collect_list(held).alias("all"))
    loads = F.expr(
        f"transform(sequence(0, {shards - 1}), s -> "
        "aggregate(filter(all, x -> x.stays AND x.shard = s), 0L, (a, x) -> a + x.bytes))"
    )
    freed = F.expr(
        "array_sort(filter(all, x -> NOT x.stays), (a, b) -> CASE WHEN a.bytes > b.bytes THEN -1 "
        "WHEN a.bytes < b.bytes THEN 1 WHEN a.virtual_slot < b.virtual_slot THEN -1 ELSE 1 END)"
    )
    dealt = F.expr(
        "aggregate(freed, named_struct('loads', loads, 'to', CAST(array() AS array<int>)), (acc, x) -> "
        "named_struct('loads', transform(acc.loads, (l, i) -> IF(i = array_position(acc.loads, array_min(acc.loads)) - 1, "
        "l + x.bytes, l)), 'to', concat(acc.to, array(CAST(array_position(acc.loads, array_min(acc.loads)) - 1 AS INT)))))"
    )
    edited = one.select("version", "all", loads.alias("loads"), freed.alias("freed")).withColumn("dealt", dealt)
    moved = edited.select("version", F.explode(F.arrays_zip("freed", "dealt.to")).alias("x")).select(
        "version", F.col("x.freed.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("shard")
    )
    kept = placed.filter("stays").select("version", "virtual_slot", "shard")
    return kept.union(moved).withColumn("version", F.col("version") + 1)


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, virtual_slot and nothing else of the text."""
    text = text_of()
    return docs.select(
        F.col("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots, text).alias("virtual_slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard, the versioned map): law ``bytes``, shards near equal in size.

    The rows carry doc_id, size, text_crc32, virtual_slot, shard and slot, a gapless place within
    the shard: shard after shard, by virtual slot, doc_id (nulls first), size and checksum. Rows equal
    in all of these are counted before anything is ordered, so a row repeated any number of times
    costs one, and each repeat gets its own place. Null text has size 8 and checksum 0. An empty table gives
    no rows and a map that deals every slot. Columns of ``docs`` besides doc_id and text are ignored.
    """
    same = ["virtual_slot", "doc_id", "size", "text_crc32"]
    rows = stage(sized(docs, slots).groupBy(*same).agg(F.count("*").alias("copies")), "shard-rows")
    whole = rows.groupBy("virtual_slot").agg(
        F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("bytes")
    )
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sizes = stage(every.join(whole, "virtual_slot", "left").na.fill(0, ["rows", "bytes"]).coalesce(1), "slot-bytes")
    start = first_map(docs.sparkSession, shards, slots)
    slot_map = stage(start.union(rebalanced(start, sizes, shards)).coalesce(1), "slot-map")
    # one row per virtual slot from here on: a bounded table
    current = slot_map.filter(F.col("version") == 2).join(sizes, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = current.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("virtual_slot").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32")
    upto = F.sum("copies").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    numbered = rows.withColumn("upto", upto).join(F.broadcast(placed), "virtual_slot")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
    out = numbered.select("*", each).select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("upto") + F.col("copy")).alias("slot")
    )
    return out, slot_map


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """The documents as Parquet, one folder per shard, by the latest version of the map of ``slots`` slots."""
    latest = slot_map.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))
    placed = docs.withColumn("virtual_slot", slot_of(F.col("doc_id"), slots, text_of())).join(F.broadcast(latest), "virtual_slot")
    placed.repartition("shard", "virtual_slot").write.partitionBy("shard").parquet(path)
