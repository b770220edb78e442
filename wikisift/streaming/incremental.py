"""Add new pages to a stored index, in batches or from a stream of files.

A batch is a segment of the index (see ``segments``) and is replaced as a whole. A run is
one stream, known by the id in its checkpoint, or one call; so a batch that is run again
after a failure replaces itself, and nothing else can. Which pages are new, and their ids,
depend only on the other batches that are stored. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wikisift.functions.urls import decode_file_name
from wikisift.operators.pages import page_texts
from wikisift.operators.postings import document_vectors, unseen
from wikisift.operators.ranking import assign_ids
from wikisift.sources.site import distinct_pages
from wikisift.sources.tables import materialize
from wikisift.streaming.segments import (
    Segment,
    SegmentedIndex,
    buckets_of,
    create_index,
    live,
    published,
    read_segments,
    write_segment,
)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of all live batches, with ``run`` and ``batch_id``."""
    every = published(spark, path)
    return read_segments(spark, path, table, live(every), buckets_of(every))


def incremental_index(pages: DataFrame, path: str, batch_id: int = 0, run: str | None = None, names_known: bool = False) -> None:
    """Index the pages ``(page_name, html)`` that no other batch has indexed.

    Only a batch of the same ``run`` and ``batch_id`` is replaced; a call without ``run``
    is a run of its own. A batch that a compaction has merged stays as it is. With
    ``names_known`` the caller vouches that no other batch of this run has these pages,
    and only the names of other runs are looked at.
    """
    spark = pages.sparkSession
    run = run or uuid.uuid4().hex
    every = published(spark, path)
    if (run, batch_id) in {key for s in every for key in s.replaces}:
        return
    others = [s for s in live(every) if not (s.run == run and s.batch_id >= batch_id)]
    last = max((s.max_id for s in others if s.max_id is not None), default=-1)
    named = [s for s in others if not (names_known and _holds_only(s, run, every))]
    if named:
        pages = unseen(pages, read_segments(spark, path, "doc_ids", named, buckets_of(every)), "page_name")

    # Texts are extracted and counted once; the ids are given to the rows that carry the counts.
    counted = materialize(document_vectors(page_texts(distinct_pages(pages)), "page_name"), "new-vectors")
    numbered = materialize(assign_ids(counted.withColumnRenamed("doc_id", "page_name"), "page_name", "doc_id", last + 1), "new-ids")
    ids, vectors = numbered.select("doc_id", "page_name"), numbered.drop("page_name")
    write_segment(spark, path, run, batch_id, ids, vectors, buckets_of(every))


def _holds_only(segment: Segment, run: str, every: list[Segment]) -> bool:
    """All that a segment holds, also by way of compactions, comes from ``run``."""
    by_key, waiting = {s.key: s for s in every}, [segment]
    while waiting:
        s = waiting.pop()
        if not s.replaces and s.run != run:
            return False
        waiting += [by_key[key] for key in s.replaces]
    return True


def stored_index(spark: SparkSession, path: str) -> SegmentedIndex:
    """All live batches as one index."""
    return SegmentedIndex.open(spark, path)


def stream_site(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of ``(page_name, html)`` for page files as they appear in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.html")
    return files.load(folder).select(
        decode_file_name(F.col("_metadata.file_name")).alias("page_name"), F.col("value").alias("html")
    )


def stream_index(pages: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the index at ``path`` up to date; with ``once`` stop after what is there now.

    The names that the stream has passed are its keyed state, so the cost of a batch does not
    grow with the index; only pages of other runs are looked up. Of several contents under
    one name in a batch, any one is kept. A page's term counts are complete within the page.
    """
    create_index(pages.sparkSession, path)

    def index_batch(df: DataFrame, batch_id: int) -> None:
        # Kept in the checkpoint, so a restarted stream is the same run and a new one is not.
        run = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        incremental_index(df, path, batch_id, run, names_known=True)

    writer = pages.dropDuplicates(["page_name"]).writeStream.foreachBatch(index_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
