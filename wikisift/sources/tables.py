"""Parquet tables: reuse of finished outputs, shared scratch tables, index layout."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikisift.functions.expr import once

ROWS_PER_BUCKET = 250_000
MANY_BUCKETS = 4096
ROWS_PER_TASK = 5_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; on a cluster the setting is
    required, as a folder of one machine would be lost with it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="wikisift-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    values that depend on the physical partitioning stay what they were.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` was committed."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of a Parquet table as its files appear, be it a folder of part files or a single file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` unless ``path`` already holds a finished table; read it back.

    What an interrupted run left behind has no commit marker and is replaced.
    """
    spark = df.sparkSession
    if not is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spread a table whose rows stand in a few splits over all cores before costly expressions.

    Splits say little: a Parquet file is cut by bytes, but its rows go with their row
    group, so many splits may be empty. Rows are counted by split, which reads no column.
    An input of even splits for all cores, as any large one has, is returned unchanged.
    Else its rows are dealt out and leave a generator, as Spark would move later filters
    below a mere repartition, into the few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if found.most * cores <= 2 * found.rows:
        return df
    return df.repartition(cores * per_core).select(once(F.struct(*df.columns)).alias("row")).select("row.*")


def choose_buckets(rows: int) -> int:
    """Term buckets for a table of so many rows: folders worth pruning, but not too many.

    From ``MANY_BUCKETS`` on, the number and the size of buckets grow alike.
    """
    buckets = max(-(-rows // ROWS_PER_BUCKET), 1)
    return buckets if buckets <= MANY_BUCKETS else round((MANY_BUCKETS * buckets) ** 0.5)


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_count(table: DataFrame) -> int | None:
    """Number of term buckets of a stored table; None for one that is not stored by term."""
    return table.schema["term"].metadata.get("buckets") if "term_bucket" in table.columns else None


def with_bucket(terms: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
    """Join keys for a term-keyed table; a stored one is also joined on its bucket.

    The bucket is the partition column of stored tables, so the join prunes their
    folders at run time.
    """
    buckets = bucket_count(table)
    if buckets is None:
        return terms, ["term"]
    return terms.withColumn("term_bucket", term_bucket(F.col("term"), buckets)), ["term_bucket", "term"]


def write_by_term(df: DataFrame, path: str, order: list[str], buckets: int, rows: int = 0) -> None:
    """Write a term-keyed table so that a lookup reads few files and row groups.

    Partitioned by a hash bucket of the term, which a join with query terms prunes at
    run time, and range-partitioned on (bucket, term, ...), so a term that fills a
    third of the table is cut into many tasks and files while rare terms share one.
    The number of buckets is kept in the schema of the table. ``rows``, if known, sets the
    number of tasks: no task writes much more than ``ROWS_PER_TASK``.
    """
    term = F.col("term").alias("term", metadata={"buckets": buckets})
    others = [c for c in df.columns if c not in ("term", "term_bucket")]
    keyed = df.select(term, *others, term_bucket(F.col("term"), buckets).alias("term_bucket"))
    keys = ["term_bucket", *order]
    # Spark merges small partitions of an unnumbered exchange, but never adds any.
    tasks = -(-rows // ROWS_PER_TASK)
    many = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(tasks, *keys) if many else keyed.repartitionByRange(*keys)
    (
        placed
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .partitionBy("term_bucket")
        .parquet(path)
    )
