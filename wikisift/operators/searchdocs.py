"""Title join and typed search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikisift.functions import values as V
from wikisift.functions.expr import let
from wikisift.functions.text import normalize_title
from wikisift.operators.ranking import with_positions
from wikisift.operators.skew import PAIRS_PER_TASK, ROWS_PER_SPLIT, full_outer_join


def join_titles(
    dump: DataFrame,
    site: DataFrame,
    skip_empty_keys: bool = False,
    rows_per_split: int = ROWS_PER_SPLIT,
    pairs_per_task: int = PAIRS_PER_TASK,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Full outer join of two ``(title, attributes, value)`` tables on normalised title.

    Gives ``(title, extern_title, site_title, attributes, value, n_attributes)``; site attributes and
    text come first. ``n_attributes`` is the size of ``attributes``: each side's own is counted before
    the join, so a reader of that number alone carries no attributes along. Columns ``keep`` of both
    tables follow, from the row that gives the title. ``skip_empty_keys`` keeps titles that normalise
    to nothing from matching each other.
    """
    nothing = F.array().cast("array<struct<name:string,value:string>>")

    def side(df: DataFrame, name: str) -> DataFrame:
        key = normalize_title(F.col("title"))
        if skip_empty_keys:
            key = F.nullif(key, F.lit(""))
        return df.select(
            key.alias("n_title"),
            F.col("title").alias(f"{name}_title"),
            F.col("attributes").alias(f"{name}_attributes"),
            F.col("value").alias(f"{name}_value"),
            F.size(F.coalesce("attributes", nothing)).alias(f"{name}_count"),
            *(F.col(c).alias(f"{name}_{c}") for c in keep),
        )

    joined = full_outer_join(
        side(dump, "extern"),
        side(site, "site"),
        "n_title",
        rows_per_split,
        pairs_per_task,
    )
    return joined.select(
        F.coalesce("extern_title", "site_title").alias("title"),
        "extern_title",
        "site_title",
        F.concat(
            F.coalesce("site_attributes", nothing), F.coalesce("extern_attributes", nothing)
        ).alias("attributes"),
        F.concat_ws(" ", "site_value", "extern_value").alias("value"),
        (F.coalesce("site_count", F.lit(0)) + F.coalesce("extern_count", F.lit(0))).alias("n_attributes"),
        *(F.when(F.col("extern_title").isNotNull(), F.col(f"extern_{c}")).otherwise(F.col(f"site_{c}")).alias(c) for c in keep),
    )


def _whole_number(attributes: Column, name: str) -> Column:
    numbers = F.transform(V.preferred_values(attributes, name), V.parse_number)
    return V.to_int_saturating(V.most_frequent(numbers))


def _clock_speed(attributes: Column, saturate: bool) -> Column:
    speeds = F.transform(V.preferred_values(attributes, "clockSpeed"), V.clock_hertz)
    best = V.most_frequent(speeds)
    return V.to_int_saturating(best).cast("double") if saturate else best


def typed_documents(joined: DataFrame, saturate: bool = True) -> DataFrame:
    """Resolve the attributes of each joined row into typed columns.

    All values of a document stand in its row, so conflicts are settled there without
    a shuffle. ``saturate=False`` keeps clock speeds of 2^31 Hz and more as they are.
    """
    clean = joined.withColumn("attributes", V.drop_blank_attributes(F.col("attributes")))
    attributes = F.col("attributes")
    tech = V.attribute_values(attributes, "tech")
    return clean.select(
        *(c for c in joined.columns if c == "doc_id"),
        "title",
        "site_title",
        "extern_title",
        F.col("value").alias("text"),
        V.preferred_values(attributes, "company").alias("company"),
        _whole_number(attributes, "release").alias("release"),
        _whole_number(attributes, "wordSize").alias("word_size"),
        _clock_speed(attributes, saturate).alias("clock_speed"),
        let(tech, lambda t: V.technology(t)[0]).alias("architecture"),
        let(tech, lambda t: V.technology(t)[1]).alias("logic"),
    )


def build_search_docs(joined: DataFrame, saturate: bool = True) -> DataFrame:
    """Typed documents with dense ``doc_id`` in title order.

    Numbered first and typed after: ranges are sampled by running the input twice, and
    resolving attributes is the dear part.
    """
    order = [F.col("title"), F.col("site_title"), F.col("extern_title"), F.xxhash64("value")]
    numbered = with_positions(joined, order, "doc_id")
    return typed_documents(numbered, saturate)
