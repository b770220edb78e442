"""A text index of immutable segments: one per batch, merged when it is read.

``<path>/<table>/run=<run>/batch_id=<n>`` holds a batch of each table: ``doc_ids``,
``vectors``, ``postings`` and ``terms``, the last two stored by term with the document
frequencies of the batch alone. One row in ``batches`` publishes a batch; it is written
last, so what a broken run left behind is never read. Searches prune the buckets of every
live segment, and sum the frequencies of the query's own terms.

``compact`` merges small segments into a new one whose row names those it replaces: readers
see the old ones or the new one, nothing between. Folders stay until ``remove_replaced``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wikisift.operators.postings import TextIndex, postings_of
from wikisift.operators.skew import join_lookup
from wikisift.sources.tables import with_bucket, write_by_term

DOC_IDS = "doc_id bigint, page_name string"
VECTORS = (
    "doc_id bigint, terms array<struct<term:string,tf:bigint>>, tf_max bigint, sum_sq bigint, len bigint"
)
POSTINGS = "term string, doc_id bigint, tf bigint, tf_max bigint, sum_sq bigint"
TERMS = "term string, df bigint"
BATCHES = (
    "n_docs bigint, max_id bigint, n_postings bigint, buckets int, replaces array<struct<run:string,batch_id:bigint>>"
)
STORED = {"doc_ids": DOC_IDS, "vectors": VECTORS, "postings": POSTINGS, "terms": TERMS}
BY_TERM = ("postings", "terms")
# Segments of more postings than this are left alone by compaction.
COMPACT_ROWS = 200_000_000


@dataclass(frozen=True)
class Segment:
    """A published batch; ``n_docs`` counts documents with terms, ``max_id`` is null for a batch without documents."""

    run: str
    batch_id: int
    n_docs: int
    max_id: int | None
    n_postings: int
    buckets: int
    replaces: tuple[tuple[str, int], ...]

    @property
    def folder(self) -> str:
        return f"run={self.run}/batch_id={self.batch_id}"

    @property
    def key(self) -> tuple[str, int]:
        return self.run, self.batch_id


def create_index(spark: SparkSession, path: str, buckets: int = 16) -> None:
    """An empty index to start from, with ``buckets`` term buckets in each segment; an existing one is left as it is."""
    first = [(0, None, 0, buckets, [])]
    spark.createDataFrame(first, BATCHES).write.mode("ignore").parquet(f"{path}/batches/run=none/batch_id=-1")


def published(spark: SparkSession, path: str) -> list[Segment]:
    """All published batches, those replaced by a compaction too: one row for each."""
    rows = spark.read.schema(f"{BATCHES}, run string, batch_id bigint").parquet(f"{path}/batches").collect()
    return [
        Segment(r.run, r.batch_id, r.n_docs, r.max_id, r.n_postings, r.buckets, tuple((s.run, s.batch_id) for s in r.replaces))
        for r in rows
    ]


def live(segments: list[Segment]) -> list[Segment]:
    """The batches that a reader takes, without the empty one of the start."""
    gone = {key for s in segments for key in s.replaces}
    return [s for s in segments if s.key not in gone and s.batch_id >= 0]


def buckets_of(segments: list[Segment]) -> int:
    return segments[0].buckets


def read_segments(spark: SparkSession, path: str, table: str, segments: list[Segment], buckets: int) -> DataFrame:
    """The rows of some batches, with ``run`` and ``batch_id``; other folders are not even listed."""
    schema = StructType.fromDDL(STORED[table])
    parts = "run string, batch_id bigint"
    if table in BY_TERM:
        term = schema["term"]
        schema = StructType([StructField("term", term.dataType, True, {"buckets": buckets}), *schema.fields[1:]])
        parts += ", term_bucket int"
    whole = StructType([*schema.fields, *StructType.fromDDL(parts).fields])
    if not segments:
        return spark.createDataFrame([], whole)
    folders = [f"{path}/{table}/{s.folder}" for s in segments]
    return spark.read.schema(whole).option("basePath", f"{path}/{table}").parquet(*folders)


def write_segment(
    spark: SparkSession, path: str, run: str, batch_id: int, ids: DataFrame, vectors: DataFrame, buckets: int,
    replaces: tuple[tuple[str, int], ...] = (),
) -> None:
    """Write all tables of a batch and publish it. ``vectors`` and ``ids`` are read several times."""
    folder = f"run={run}/batch_id={batch_id}"
    if (run, batch_id) in {s.key for s in published(spark, path)}:
        _delete(spark, f"{path}/batches/{folder}")  # not published while its tables are replaced
    vectors.write.mode("overwrite").parquet(f"{path}/vectors/{folder}")
    ids.write.mode("overwrite").parquet(f"{path}/doc_ids/{folder}")
    stored = spark.read.schema(VECTORS).parquet(f"{path}/vectors/{folder}")
    sizes = stored.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count_if(F.col("len") > 0)).first()
    write_by_term(postings_of(stored), f"{path}/postings/{folder}", ["term", "doc_id"], buckets, sizes[0])
    postings = spark.read.schema(f"{POSTINGS}, term_bucket int").parquet(f"{path}/postings/{folder}")
    counts = postings.groupBy("term_bucket", "term").agg(F.count(F.lit(1)).alias("df")).select("term", "df")
    write_by_term(counts, f"{path}/terms/{folder}", ["term"], buckets)
    last = spark.read.schema(DOC_IDS).parquet(f"{path}/doc_ids/{folder}").agg(F.max("doc_id")).first()[0]
    row = (sizes[1], last, sizes[0], buckets, list(replaces))
    spark.createDataFrame([row], BATCHES).coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/{folder}")


@dataclass(frozen=True, kw_only=True)
class SegmentedIndex(TextIndex):
    """The live segments as one index. ``parts`` holds the term counts of each segment."""

    parts: DataFrame
    n_docs: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentedIndex:
        every = published(spark, path)
        segments, buckets = live(every), buckets_of(every)
        vectors, postings, parts = (
            read_segments(spark, path, table, segments, buckets).drop("run", "batch_id") for table in ("vectors", *BY_TERM)
        )
        n_docs = sum(s.n_docs for s in segments)
        summed = parts.groupBy("term_bucket", "term").agg(F.sum("df").alias("df"))
        return cls(vectors, postings, _with_idf(summed, n_docs).select("term", "df", "idf"), parts=parts, n_docs=n_docs)

    def lookup(self, terms: DataFrame, fits: bool) -> DataFrame:
        """The counts of the given terms only are read and summed."""
        keyed, keys = with_bucket(terms, self.parts)
        found = join_lookup(self.parts, keyed, keys, "term", fits)
        return _with_idf(found.groupBy(*terms.columns).agg(F.sum("df").alias("df")), self.n_docs)


def _with_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    return counts.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def compact(spark: SparkSession, path: str, most_rows: int = COMPACT_ROWS, least: int = 2) -> Segment | None:
    """Merge the live segments of up to ``most_rows`` postings into one, if there are ``least`` of them.

    Frequencies are added up and postings merged from what is stored; no text is read again.
    """
    every = published(spark, path)
    buckets = buckets_of(every)
    small = [s for s in live(every) if s.n_postings <= most_rows]
    if len(small) < least:
        return None
    ids, vectors = (read_segments(spark, path, t, small, buckets).drop("run", "batch_id") for t in ("doc_ids", "vectors"))
    run = f"compact-{uuid.uuid4().hex}"
    write_segment(spark, path, run, 0, ids, vectors, buckets, tuple(s.key for s in small))
    return next(s for s in published(spark, path) if s.run == run)


def remove_replaced(spark: SparkSession, path: str) -> list[Segment]:
    """Delete the tables of the segments that compactions replaced, once no reader uses them; their rows in ``batches`` stay."""
    every = published(spark, path)
    gone = {key for s in every for key in s.replaces}
    dead = [s for s in every if s.key in gone]
    for s in dead:
        for table in STORED:
            _delete(spark, f"{path}/{table}/{s.folder}")
    return dead


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

