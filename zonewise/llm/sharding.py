"""Sharding by fixed virtual slots.

A record's key hashes into one of a fixed number of slots, bytes are summed up per slot, and a small versioned table maps
slots to shards. The table, not the hash, decides where a record lives: rebalancing writes a new version that moves
whole slots. Everything is DataFrame expressions; only per-slot sums (``SLOTS`` rows) ever meet in one task.

Rows of equal text under different keys are records of their own: the key alone decides, so copies may lie in different shards.

Defined cases: a null text has size 1 and crc 0; rows without a key hash by their text; repeated rows stay separate rows
with positions of their own; an empty table gives an empty result (and a map of empty slots).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
# Rows of one slot are numbered in cells of about this many rows, so no task sorts a whole slot.
CELL_ROWS = 100_000

size_of = lambda text: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(rows: DataFrame, key: str, text: str, slots: int = SLOTS, cells: int = 1) -> DataFrame:
    """Key, size, text_crc32, virtual_slot and numbering cell of every row."""
    own = F.when(F.col(key).isNull(), F.xxhash64(F.col(text), F.lit("no key"))).otherwise(F.xxhash64(F.col(key)))
    return rows.select(
        F.col(key),
        size_of(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(own, F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.xxhash64(own, F.lit("cell")), F.lit(cells)).cast("int").alias("cell"),
    )


def first_map(per_slot: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: slots in falling order of bytes, each to the shard with the least bytes so far.

    The fold runs over one array of ``slots`` entries, whatever the size of the corpus. Slots without rows are mapped as
    well, since later records may fall into them.
    """
    spark = per_slot.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    ordered = (
        every.join(per_slot.select("virtual_slot", "bytes"), "virtual_slot", "left")
        .select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("virtual_slot").alias("s")))).alias("all"))
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int,bytes:bigint>>").alias("out"),
    )

    def place(acc: Column, x: Column) -> Column:
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        # an empty slot weighs one byte, so that empty slots spread too
        loads = F.transform(acc["loads"], lambda v, i: v + F.when(i == least, F.greatest(-x["b"], F.lit(1))).otherwise(0))
        row = F.struct(x["s"].alias("virtual_slot"), least.alias("shard"), (-x["b"]).alias("bytes"))
        return F.struct(loads.alias("loads"), F.concat(acc["out"], F.array(row)).alias("out"))

    placed = ordered.select(F.explode(F.aggregate("all", start, place, lambda acc: acc["out"])).alias("m"))
    return placed.select("m.*", F.lit(1).alias("version"))


def add_shard(current: DataFrame) -> DataFrame:
    """The next version with one more shard: every shard gives whole slots, nearest to its excess over the new mean."""
    n = F.max("shard").over(Window.partitionBy("version")) + 1
    in_shard = Window.partitionBy("version", "shard")
    run = in_shard.orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    load, total = F.sum("bytes").over(in_shard), F.sum("bytes").over(Window.partitionBy("version"))
    return (
        current.withColumns({"_n": n, "_load": load, "_total": total, "_run": F.sum("bytes").over(run)})
        .withColumn("shard", F.when(F.col("_run") - F.col("bytes") / 2 <= F.col("_load") - F.col("_total") / (F.col("_n") + 1), F.col("_n")).otherwise(F.col("shard")))
        .select("virtual_slot", F.col("shard").cast("int"), "bytes", (F.col("version") + 1).alias("version"))
    )


def write_map(version: DataFrame, folder: str) -> None:
    """Append one version to the map's table; earlier versions stay readable."""
    version.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default."""
    every = spark.read.schema("virtual_slot int, shard int, bytes bigint, version int").parquet(folder)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == version)


def shard(docs: DataFrame, folder: str, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Assign every row to a shard by its virtual slot and number the rows of each shard from 0.

    Writes versions 1 (``shards`` shards) and 2 (one more) of the map to ``folder``. Returns key, size, text_crc32,
    virtual_slot, shard, slot (position in the shard) and next_shard (under version 2). Law: the shards' bytes are nearly equal.
    """
    spark = docs.sparkSession
    cells = max(1, -(-docs.count() // (slots * CELL_ROWS)))
    rows = keyed(docs, key, text, slots, cells)
    per_cell = rows.groupBy("virtual_slot", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    per_cell.write.parquet(f"{folder}/cells")
    per_cell = spark.read.schema(per_cell.schema).parquet(f"{folder}/cells")
    per_slot = per_cell.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"))
    write_map(first_map(per_slot, shards, slots), f"{folder}/map")
    one = read_map(spark, f"{folder}/map", 1)
    write_map(add_shard(one), f"{folder}/map")
    two = read_map(spark, f"{folder}/map", 2).select("virtual_slot", F.col("shard").alias("next_shard"))

    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        per_cell.select("virtual_slot", "cell", "n")
        .join(one.select("virtual_slot", "shard"), "virtual_slot")
        .join(two, "virtual_slot")
        .withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    order = Window.partitionBy("virtual_slot", "cell").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(order) - 1)
        .join(placed, ["virtual_slot", "cell"])
        .select(
            F.col(key), "size", "text_crc32", "shard", (F.col("_base") + F.col("_at")).cast("long").alias("slot"), "virtual_slot", "next_shard"
        )
    )
