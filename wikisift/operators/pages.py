"""Page filters and the two article tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikisift.functions import presets
from wikisift.functions.attributes import Source, extract_attributes
from wikisift.functions.expr import let, once
from wikisift.functions.text import (
    dump_categories,
    html_to_text,
    site_categories,
    title_from_page_name,
)


def is_article_page(name: Column, html: Column) -> Column:
    """False for category, special and redirect pages (F2)."""
    skipped = reduce(
        Column.__or__, (F.startswith(name, F.lit(p)) for p in presets.SKIPPED_NAME_PREFIXES)
    )
    return ~skipped & ~F.contains(html, F.lit(presets.REDIRECT_MARK))


def on_topic(categories: Column, allow: str, deny: str) -> Column:
    """The category list matches ``allow`` and not ``deny``; NULL for NULL.

    Bound once: Catalyst would copy the expression behind ``categories`` into both tests.
    """
    return let(categories, lambda c: c.rlike(allow) & ~c.rlike(deny))


def page_texts(pages: DataFrame, unknown: str = "keep", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(page_name, text)`` of article pages, after the columns of ``keep``."""
    kept = pages.where(is_article_page(F.col("page_name"), F.col("html")))
    return kept.select(*keep, "page_name", once(html_to_text(F.col("html"), unknown)).alias("text"))


def dump_articles(
    dump: DataFrame, allow: str = presets.DUMP_ALLOW, deny: str = presets.DUMP_DENY, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(title, value)`` of main-namespace dump pages on the topic."""
    articles = dump.where(F.col("ns") == 0).select(*keep, "title", F.col("revision.text._VALUE").alias("value"))
    return articles.where(on_topic(dump_categories(F.col("value")), allow, deny))


def site_articles(
    pages: DataFrame, allow: str = presets.SITE_ALLOW, deny: str = presets.SITE_DENY, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(title, value)`` of site pages whose category line is on the topic."""
    texts = page_texts(pages, keep=keep).where(on_topic(site_categories(F.col("text")), allow, deny))
    return texts.select(
        *keep, title_from_page_name(F.col("page_name")).alias("title"), F.col("text").alias("value")
    )


def with_attributes(
    articles: DataFrame, rules: tuple[Source, ...] = presets.COMPUTERS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Add the ``attributes`` array found in ``value``, ordered by title (A1, O1).

    Sorted before the rules run: a sort samples its input, which would run them twice.
    """
    return articles.orderBy("title").select(
        *keep, "title", extract_attributes("value", rules).alias("attributes"), "value"
    )
