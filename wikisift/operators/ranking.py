"""Ordering, ranks and dense numbers without a single-task window (O1, W1, Q-RANK, Q-TOP)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikisift.sources.tables import materialize

# Up to this many rows per group Spark limits each group before it shuffles
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# So many rows are ranked in a task.
ROWS_PER_SORT = 1_000_000
_POSITION_BITS = 33


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position", tasks: int = 0) -> DataFrame:
    """Add the 0-based position of each row in a total order.

    Rows are range-partitioned and sorted; ``monotonically_increasing_id`` then holds
    the partition and the place in it. The table is written once, so the partitions
    cannot change between counting them and adding up their sizes. Only one row per
    partition takes part in the running sum. Spark merges small partitions of an unnumbered
    exchange but never adds any; ``tasks`` asks for more.
    """
    many = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(tasks, *order) if many else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(F.col("_id"), _POSITION_BITS)
    within = F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, within + F.col("_offset")).drop("_id", "_part", "_offset")


def assign_ids(names: DataFrame, name_col: str, id_col: str = "doc_id", start: int = 0) -> DataFrame:
    """Dense ids in name order, counting from ``start``."""
    numbered = with_positions(names, [F.col(name_col)], "_position")
    return numbered.select((F.col("_position") + start).alias(id_col), *names.columns)


def ranked(
    df: DataFrame, group: str, order: Sequence[Column], limit: int | None = None, name: str = "rank"
) -> DataFrame:
    """Rank rows within ``group`` from 1, keeping the first ``limit`` of each group.

    With a usual limit each task keeps only its own best rows before the shuffle. A
    complete ranking sorts all groups in one total order instead, so a group of any
    size is spread over the cluster. It is written before, as sampling the ranges would run
    it twice, and its number of rows sets the tasks.
    """
    if limit is not None and limit <= GROUP_LIMIT:
        window = Window.partitionBy(group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint")).where(F.col(name) <= limit)
    df = materialize(df, "unranked")
    placed = with_positions(df, [F.col(group), *order], "_position", -(-df.count() // ROWS_PER_SORT))
    firsts = placed.groupBy(group).agg(F.min("_position").alias("_first"))
    result = placed.join(firsts, group).withColumn(name, F.col("_position") - F.col("_first") + 1)
    if limit is not None:
        result = result.where(F.col(name) <= limit)
    return result.drop("_position", "_first")


def most_frequent_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group, the smallest on a tie (G7 over rows); NULL is no value.

    Counted per (group, value) first, so a group of any size arrives pre-aggregated.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(value).alias("_v"))).alias("_best"))
    return best.select(group, F.col("_best._v").alias(value))
