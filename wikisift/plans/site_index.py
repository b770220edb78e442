"""Site pages to a stored TF-IDF index, and searches with page names and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.functions.urls import page_url
from wikisift.operators.pages import page_texts
from wikisift.operators.postings import TextIndex
from wikisift.operators.ranking import assign_ids
from wikisift.operators.search import search
from wikisift.sources.tables import materialize


def build_site_index(pages: DataFrame, path: str) -> tuple[DataFrame, TextIndex]:
    """Number the article pages ``(page_name, html)`` by name and index their text."""
    spark = pages.sparkSession
    texts = page_texts(pages)
    assign_ids(texts.select("page_name"), "page_name").write.mode("overwrite").parquet(f"{path}/doc_ids")
    doc_ids = spark.read.parquet(f"{path}/doc_ids")
    return doc_ids, TextIndex.build(texts.join(doc_ids, "page_name")).save(path)


def search_pages(
    queries: DataFrame, doc_ids: DataFrame, index: TextIndex, prefix: str, **options
) -> DataFrame:
    """Hits of :func:`search` with page names and URLs (Q-SHOW)."""
    hits = materialize(search(queries, index, **options), "hits").join(doc_ids, "doc_id")
    return hits.withColumn("url", page_url(F.col("page_name"), prefix))


def count_hits(hits: DataFrame) -> DataFrame:
    """``(query_id, n_hits)``."""
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
