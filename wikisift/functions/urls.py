"""Page names, link resolution and URL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikisift.functions.expr import let

# Link pattern, pages a crawl leaves out, escape code of file names.
HREF = r'href="([^"]+)"'
EXCLUDED_SPECIAL = (
    "Special:Contributions",
    "Special:WhatLinksHere",
    "Special:RecentChangesLinked",
    "Special:Version",
)
EXCLUDED_NAMESPACES = ("User:", "Help:", "Template:", "Talk:", "File:", "MediaWiki:", "User_talk:")
FILE_NAME_ESCAPE = r"\(([0-9a-f]+)\)"
# Characters a URL path must not hold unescaped; '%' first, as the others produce it.
PATH_ESCAPES = "%\t\n\r \"#<>?[\\]^`{|}" + chr(0xA0)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def page_name(url: Column, prefix: str) -> Column:
    """The URL relative to the site prefix, or the URL itself when it lies elsewhere."""
    rest = F.substring(url, F.lit(len(prefix) + 1), F.length(url))
    return F.when(F.startswith(url, F.lit(prefix)), rest).otherwise(url)


def page_url(name: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), name)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def _normalize(path: Column) -> Column:
    """A rooted path without empty and ``.`` segments; ``..`` takes the segment before it, unless that is ``..`` too."""

    def last(kept: Column) -> Column:
        return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))

    def step(kept: Column, part: Column) -> Column:
        takes = (part == "..") & (F.size(kept) > 0) & (last(kept) != "..")
        return F.when(takes, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.array_append(kept, part))

    parts = F.filter(F.split(path, "/", -1), lambda part: ~part.isin("", "."))

    def joined(kept: Column) -> Column:
        # A final slash, '.' or '..' that took a segment names a folder.
        folder = path.rlike(r"/\.?$") | (path.rlike(r"/\.\.$") & (last(kept) != ".."))
        slash = F.when(folder & (F.size(kept) > 0), "/").otherwise("")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), slash)

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"//|(^|/)\.\.?(/|$)"), let(kept, joined)).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """An href against the URL of its page, without fragment.

    Only paths merged with the page's folder are normalised; rooted ones stay as written.
    """
    page = F.regexp_replace(base, "[?#].*$", "")
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)", 1)
    path = F.substring(page, F.length(origin) + 1, F.length(page))
    folder = F.coalesce(F.regexp_extract(path, r"^(.*/)", 1), F.lit(""))
    folder = F.when(folder == "", "/").otherwise(folder)

    def resolved(target: Column) -> Column:
        target_path = F.regexp_replace(target, r"\?.*$", "")
        query = F.substring(target, F.length(target_path) + 1, F.length(target))
        return (
            F.when(target == "", strip_fragment(base))
            .when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
            .when(
                F.startswith(target, F.lit("/")),
                F.concat(origin, target),
            )
            .otherwise(F.concat(origin, _normalize(F.concat(folder, target_path)), query))
        )

    return let(strip_fragment(href), resolved)


def is_content_url(url: Column, prefix: str) -> Column:
    """True for URLs of the site that lead to content pages."""
    name = page_name(url, prefix)
    inside = F.startswith(url, F.lit(prefix)) & ~F.contains(url, F.lit("#"))
    special = reduce(Column.__or__, (F.contains(url, F.lit(s)) for s in EXCLUDED_SPECIAL))
    other = reduce(Column.__or__, (F.startswith(name, F.lit(n)) for n in EXCLUDED_NAMESPACES))
    return inside & ~special & ~other


def decode_file_name(file_name: Column) -> Column:
    """Page name of a stored page file: ``Special(3a)Name.html`` is ``Special:Name``."""
    stem = F.regexp_replace(file_name, r"\.html$", "")
    codes = F.regexp_extract_all(stem, F.lit(FILE_NAME_ESCAPE), F.lit(1))

    def char(code: Column) -> Column:
        # lpad also cuts, so take the low 16 bits first
        return F.decode(F.unhex(F.lpad(F.right(code, F.lit(4)), 4, "0")), "UTF-16BE")

    pieces = F.zip_with(
        F.split(stem, FILE_NAME_ESCAPE, -1),
        codes,
        lambda piece, code: F.concat(piece, F.coalesce(char(code), F.lit(""))),
    )
    return F.array_join(pieces, "")


def result_url(title: Column, base: str) -> Column:
    """Base URL plus the percent-encoded title."""
    encoded = title
    for char in PATH_ESCAPES:
        escape = "".join(f"%{byte:02X}" for byte in char.encode())
        encoded = F.replace(encoded, F.lit(char), F.lit(escape))
    return F.concat(F.lit(base), encoded)
