"""Dump and site to searchable documents: read, filter, extract, join, index.

What was read is kept in a manifest of files with their length and time of change. A file
that is new or changed is read in the next build, and its rows take the place of those of
the run before; rows of files that are gone are no longer part of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wikisift.functions import presets
from wikisift.functions.attributes import Source
from wikisift.operators.fielded import FieldIndex
from wikisift.operators.pages import dump_articles, site_articles, with_attributes
from wikisift.operators.searchdocs import build_search_docs, join_titles
from wikisift.sources.dump import DUMP_SCHEMA, list_dumps, read_dump
from wikisift.sources.site import list_site, read_site
from wikisift.sources.tables import materialize

MANIFEST = "file string, length bigint, modified timestamp, written bigint"


@dataclass(frozen=True)
class Topics:
    """Which articles are kept and what is read from them; other patterns or rules need another work folder."""

    dump_allow: str = presets.DUMP_ALLOW
    dump_deny: str = presets.DUMP_DENY
    site_allow: str = presets.SITE_ALLOW
    site_deny: str = presets.SITE_DENY
    rules: tuple[Source, ...] = presets.COMPUTERS


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length, modified, written, run)`` of the last run that read each file."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{path}/files/run=none")
    done = spark.read.schema(f"{MANIFEST}, run string").parquet(f"{path}/files")
    last = F.max_by(F.struct("length", "modified", "written", "run"), "written")
    return done.groupBy("file").agg(last.alias("last")).select("file", "last.*")


def _kept_up(spark: SparkSession, files: DataFrame, read: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """A table of all ``files(file, length, modified)``; new and changed ones are read by ``read(files)`` and added.

    The rows of a run are written first, then its part of the manifest, which publishes
    them. A row counts if its run is the last that read its file.
    """
    files = materialize(files, "listed-files")
    known = _manifest(spark, path)
    missing = materialize(files.join(known, ["file", "length", "modified"], "left_anti"), "missing-files")
    rows = read(missing)
    if not missing.isEmpty():
        run, last = uuid.uuid4().hex, known.agg(F.max("written")).first()[0] or 0
        rows.write.parquet(f"{path}/rows/run={run}")
        missing.withColumn("written", F.lit(last + 1)).write.parquet(f"{path}/files/run={run}")
    whole = StructType([*rows.schema.fields, StructField("run", StringType())])
    live = _manifest(spark, path).join(files, "file", "left_semi").select("file", "run")
    if live.isEmpty():
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(whole).parquet(f"{path}/rows").join(live, ["file", "run"], "left_semi").select(*rows.columns)


def dump_table(spark: SparkSession, folder: str, target: str, work: str) -> DataFrame:
    """Pages of the dumps a target names as Parquet, with their ``file``; each dump is converted once, and again when it changes."""
    files = list_dumps(spark, folder, target)
    paths = files.select("file", "path")

    def read(missing: DataFrame) -> DataFrame:
        found = [r["path"] for r in missing.join(paths, "file").collect()]  # one row per dump file
        if not found:
            return spark.createDataFrame([], StructType([StructField("file", StringType()), *StructType.fromDDL(DUMP_SCHEMA).fields]))
        return read_dump(spark, found, with_file=True)

    return _kept_up(spark, files.select("file", "length", "modified"), read, f"{work}/dumps")


def dump_attribute_table(spark: SparkSession, folder: str, target: str, work: str, topics: Topics = Topics()) -> DataFrame:
    """Articles of the dumps with their attributes, extracted once for each state of a dump."""
    pages = dump_table(spark, folder, target, work)
    files = list_dumps(spark, folder, target).select("file", "length", "modified")

    def read(missing: DataFrame) -> DataFrame:
        part = pages.join(missing.select("file"), "file", "left_semi")
        articles = dump_articles(part, topics.dump_allow, topics.dump_deny, keep=("file",))
        return with_attributes(articles, topics.rules, keep=("file",))

    name = "all" if target == "*" else files.first()["file"].rpartition("/")[2]
    return _kept_up(spark, files, read, f"{work}/attr_dumps-{name}").drop("file")


def site_attribute_table(spark: SparkSession, folder: str, work: str, topics: Topics = Topics()) -> DataFrame:
    """Articles of the site with their attributes, extracted once for each state of a page file."""
    pages = read_site(spark, folder)

    def read(missing: DataFrame) -> DataFrame:
        part = pages.withColumn("file", F.col("page_name")).join(missing.select("file"), "file", "left_semi")
        articles = site_articles(part, topics.site_allow, topics.site_deny, keep=("file",))
        return with_attributes(articles, topics.rules, keep=("file",))

    return _kept_up(spark, list_site(spark, folder), read, f"{work}/attr_site").drop("file")


def build_dump_index(
    spark: SparkSession, dump_folder: str, target: str, site_folder: str, work: str, output: str,
    topics: Topics = Topics(), skip_empty_keys: bool = False, saturate: bool = True,
) -> FieldIndex:
    """The whole pipeline; intermediate tables in ``work`` are reused, the index is replaced.

    All dumps of a target form one table, so several dumps give one index.
    """
    joined = join_titles(
        dump_attribute_table(spark, dump_folder, target, work, topics),
        site_attribute_table(spark, site_folder, work, topics),
        skip_empty_keys=skip_empty_keys,
    )
    return FieldIndex.build(build_search_docs(joined, saturate)).save(output)
