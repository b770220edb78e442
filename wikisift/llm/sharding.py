"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame functions only.

Documents are range-partitioned and sorted by id. Each partition's total gives the bytes
before it; a running sum inside the partition does the rest. A document belongs to the
shard in which its middle byte falls when the whole is cut at equal targets, so shards
are runs of the id order and differ from the target by less than one document.

Only id, size and checksum are moved. Windows run inside one partition, over one row per
partition, or over one row per shard.

Defined results: a null text has size 8 and checksum 0, like an empty one; null ids come
first; rows with the same id keep a fixed order among themselves and may be cut apart.
An empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikisift.sources.tables import materialize


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 8 for its length field."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    rows = docs.select(
        F.col(key).alias("doc_id"), text_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "text_crc32", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = placed.select(
        "*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("own_bytes"),
        (F.row_number().over(inside) - 1).alias("own_rows"),
    )
    middle = 2 * (F.col("bytes_before") + F.col("own_bytes")) + F.col("size")
    numbered = running.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", F.expr("rows_before + own_rows").alias("position"),
        F.least(F.floor(middle / (2 * F.col("total")) * shards), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    numbered = materialize(numbered, "shard-numbers")
    firsts = numbered.groupBy("shard").agg(F.min("position").alias("first"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir):
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
