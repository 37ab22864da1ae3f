"""Sharding into contiguous shards of near equal bytes, by global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import table, written

#: Rows that one range partition aims at; its running sum is one sorted window group.
ROWS_PER_RANGE = 1_000_000


def byte_balanced_shards(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of df; shards are contiguous in key order.

    Rows are dealt to range partitions of the key; each partition's total of bytes and rows is one small row, whose
    running sums give every partition its global offset, and a window inside the partition does the rest. A row goes to
    the shard in which the middle of its byte range falls, so a shard misses its equal target by half a row at most at
    either end. slot counts a shard's rows from 0 in the same order.

    size is the UTF-8 bytes plus 1; a null text has size 1 and checksum 0, as the empty text. Null keys come first, ties
    and repeated rows are ordered by checksum, size and place in the input, each keeps a slot of its own. An empty table
    gives no rows. A row larger than a target leaves shards empty. Other columns of df are not read.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = written(
        df.select(
            F.col(key),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ).withColumn("tie", F.monotonically_increasing_id()),
        "shard-sizes",
    )
    order = [F.col(key).asc_nulls_first(), "text_crc32", "size", "tie"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // ROWS_PER_RANGE))
    placed = written(narrow.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "shard-ranges")

    totals = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row for each range partition
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = f"(2 * start + size) * {n_shards} div (2 * all_bytes)"
    cut = (
        placed.join(F.broadcast(offsets), "range")
        .withColumn("start", start)
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(middle).cast("int"))
        .withColumn("shard", F.least("shard", F.lit(n_shards - 1)))
    )
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def op5_sharding(spark, sf_dir):
    """Every document's shard by the law of bytes; see byte_balanced_shards for nulls, ties and empty tables."""
    return byte_balanced_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
