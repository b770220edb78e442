"""Folders of stored HTML pages (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikisift.functions.urls import decode_file_name


def read_site(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_name, html)``, one row per ``*.html`` file."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.html").text(folder)
    return files.select(
        decode_file_name(F.col("_metadata.file_name")).alias("page_name"), F.col("value").alias("html")
    )


def list_site(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, length, modified)`` of the page files, by page name; no page is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(
        decode_file_name(F.col("_metadata.file_name")).alias("file"), "length", F.col("modificationTime").alias("modified")
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page name, as the name alone identifies a page.

    Of several contents the smallest is kept, so that every run keeps the same one.
    Copies are reduced on the map side before the shuffle.
    """
    others = [c for c in pages.columns if c != "page_name"]
    if not others:
        return pages.distinct()
    kept = pages.groupBy("page_name").agg(F.min(F.struct(*others)).alias("kept"))
    return kept.select("page_name", "kept.*")
