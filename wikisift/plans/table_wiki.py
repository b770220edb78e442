"""A wiki made of table rows, to run the dump and site pipelines on the benchmark tables.

Each part becomes a dump page, parts above a size also a site page, each supplier a
site page. All markup is put together by Spark, so it grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUMP_CATEGORY = {
    "STANDARD": "Vacuum tube computers",
    "LARGE": "Electro-mechanical computers",
    "ECONOMY": "Comic book computers",
    "MEDIUM": "Intel processors",
    "SMALL": "Word processors",
}
SITE_MIN_SIZE = 26

PART_PAGE = (
    "{{Infobox computer\n| name = $p_name$\n| manufacturer = [[$p_brand$ works|$p_brand$]]\n"
    "| release date = {{start date|$y40$}}\n| bits = $p_size$-bit\n"
    "| cpu = Core @ $p_size$.5 [[Hertz|MHz]]\n}}\n"
    "The $p_name$ was developed by [[$p_brand$ labs]] in $y40$. "
    "It was released in $y50$ on 3 May $y51$.\n[[Category:$category$|x]] [[Category:$second$]]"
)
SITE_PAGE = (
    '<p>The <a href="/wiki/x">$p_name$</a> &amp; sold by <a href="/wiki/y">$p_brand$ shop</a> on $y30$.</p> '
    '<a href="/c">Categories</a>: <a href="/d">$p_brand$ Computers</a><a href="/e">$p_type$</a>'
)
SUPPLIER_PAGE = '<p>Made by <b>$s_name$</b></p> <a href="/c">Category</a>: <a href="/d">$category$</a>'


def _fill(template: str, **extra: Column) -> Column:
    """The template with each ``$name$`` replaced by a column."""
    pieces = re.split(r"\$(\w+)\$", template)
    return F.concat(
        *(extra.get(p, F.col(p)) if i % 2 else F.lit(p) for i, p in enumerate(pieces))
    )


def part_dump(part: DataFrame) -> DataFrame:
    """``(id, ns, title, value)``: one dump page per part; promotions are talk pages."""
    size = F.col("p_size")
    category = F.lit("Promotions")
    for kind, name in DUMP_CATEGORY.items():
        category = F.when(F.col("p_type") == kind, name).otherwise(category)
    second = F.when(size >= SITE_MIN_SIZE, "Serial computers").otherwise("Machines")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") == "PROMO", 1).otherwise(0).cast("bigint").alias("ns"),
        F.concat("p_name", F.lit(" "), "p_partkey", F.lit(" ("), F.lower("p_type"), F.lit(")")).alias("title"),
        _fill(
            PART_PAGE, y40=size + 1940, y50=size + 1950, y51=size + 1951, category=category, second=second
        ).alias("value"),
    )


def dump_xml(pages: DataFrame) -> DataFrame:
    """The dump pages as XML ``<page>`` elements, one text row each."""

    def escaped(column: str) -> Column:
        text = F.col(column)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    template = (
        "<page>\n<title>$title$</title>\n<ns>$ns$</ns>\n<id>$id$</id>\n"
        '<revision>\n<text xml:space="preserve">$value$</text>\n</revision>\n</page>'
    )
    return pages.select(_fill(template, title=escaped("title"), value=escaped("value")).alias("value"))


def as_dump_rows(pages: DataFrame) -> DataFrame:
    """The dump pages in the shape of a parsed dump."""
    text = F.struct(F.col("value").alias("_VALUE"))
    return pages.select("id", "ns", "title", F.struct(text.alias("text")).alias("revision"))


def site_pages(part: DataFrame, supplier: DataFrame) -> DataFrame:
    """``(page_name, html)`` of the site."""
    parts = part.where(F.col("p_size") >= SITE_MIN_SIZE).select(
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_partkey").alias("page_name"),
        _fill(SITE_PAGE, y30=F.col("p_size") + 1930).alias("html"),
    )
    category = F.when(F.col("s_acctbal") >= 0, "Mainframes").otherwise("Operating systems")
    suppliers = supplier.select(
        F.concat(F.lit("Supplier_"), "s_suppkey").alias("page_name"),
        _fill(SUPPLIER_PAGE, category=category).alias("html"),
    )
    return parts.unionByName(suppliers)
