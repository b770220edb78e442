"""Wiki dumps: bz2 XML files of <page> elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: the columns of a dump page.
DUMP_SCHEMA = (
    "id BIGINT, ns BIGINT, redirect STRUCT<_title: STRING>, "
    "revision STRUCT<comment: STRING, contributor: STRUCT<id: BIGINT, ip: STRING, username: STRING>, "
    "format: STRING, id: BIGINT, minor: STRING, model: STRING, origin: BIGINT, parentid: BIGINT, "
    "sha1: STRING, text: STRUCT<_VALUE: STRING, _bytes: BIGINT, _sha1: STRING, `_xml:space`: STRING>, "
    "timestamp: TIMESTAMP>, title STRING"
)
DUMP_FILES = "*.bz2"


def list_dumps(spark: SparkSession, folder: str, target: str = "*") -> DataFrame:
    """``(path, file, length, modified)`` of the dumps a target names: ``*`` all, ``1`` the first by name, else one file.

    ``file`` is the name that rows read from it carry.
    """
    pattern = DUMP_FILES if target in ("*", "1") else target.removesuffix(".bz2") + ".bz2"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    files = files.select("path", F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    return files.orderBy("path").limit(1) if target == "1" else files


def read_dump(
    spark: SparkSession, paths: str | list[str], schema: str | StructType = DUMP_SCHEMA, with_file: bool = False
) -> DataFrame:
    """One row per ``<page>`` (S1), with the ``file`` it comes from if asked for.

    The XML reader takes a whole bz2 file in one task. Cut at the end tag of a page
    instead, a dump is text with a record delimiter, which Spark splits; the escaped
    wiki text cannot hold that tag. Give a smaller ``schema`` to parse fewer fields.
    """
    records = spark.read.option("lineSep", "</page>").text(paths)
    file = [F.col("_metadata.file_path").alias("file")] * with_file
    start = F.regexp_extract("value", r"(?s)(<page[\s>].*)", 1)
    pages = records.select(*file, start.alias("page")).where(F.col("page") != "")
    parsed = F.from_xml(F.concat("page", F.lit("</page>")), schema, {"rowTag": "page"})
    return pages.select(*["file"] * with_file, parsed.alias("p")).select(*["file"] * with_file, "p.*")


def read_dump_target(spark: SparkSession, folder: str, target: str = "*") -> DataFrame:
    """All pages of the dumps that ``target`` names, as one DataFrame."""
    if target == "1":
        first = list_dumps(spark, folder, target).first()
        if first is None:
            raise FileNotFoundError(f"No {DUMP_FILES} in {folder}")
        return read_dump(spark, first["path"])
    name = DUMP_FILES if target == "*" else target.removesuffix(".bz2") + ".bz2"
    return read_dump(spark, f"{folder}/{name}")
