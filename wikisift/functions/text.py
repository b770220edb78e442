"""Text expressions: HTML to text, tokens, titles, category lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikisift.functions.expr import let

# Token shape and delimiters, title and category patterns.
TOKEN = r"[a-zA-Z0-9]++(?:[-\/]++[a-zA-Z0-9]++)*+"
TOKEN_DELIMITER = r"[-\/]"
PARENTHESES = r"\(.*?\)"
DUMP_CATEGORY = r"\[\[Category:(.*?)[\]|]"
SITE_CATEGORIES = r"\[\[Categor(?:ies|y)\]\]: ((?:\[\[.*?\]\])++)"
SITE_CATEGORY = r"\[\[(.*?)\]\]"
ENTITIES = {"&gt;": ">", "&lt;": "<", "&quot;": '"', "&amp;": "&"}
UNKNOWN_ENTITY = r"&(?!(?:amp|gt|lt|quot);)[a-z]+;"

# One HTML tag. After the name, a tag body is read as runs of non-space characters:
# a run starts with a word character or '-', may hold a quoted string right after
# `x=`, and a tag ends at the furthest '>' that such runs reach. Every loop is
# possessive, so the time is linear in the tag and the regex stack does not grow.
# Group 1 is '/' or '!', group 2 or 3 the name (3: the name gives up its last
# character as the start of the first run, as in <svg:rect>).
_STEP = r'(?:[^\s">]|\s++[\w-]|(?<=[\w-]=)"[^"]*+"\s*+[\w-])'
_LAST = r'(?:\s++|(?<=[\w-]=)"[^"]*+"\s*+)/?+>'
_BODY = rf"[\w-](?:(?:{_STEP}*+>)++(?:{_STEP}*+{_LAST})?+|{_STEP}*+{_LAST})"
HTML_TAG = rf"<([/!]?)(?:([\w-]++)\s*+(?:/?+>|{_BODY})|((?:[\w-](?=[\w-]))++){_BODY})"

# Unicode noncharacters, reserved for internal use: they frame a tag name while a
# page is being rewritten. Should a page hold them, they are escaped and restored.
_OPEN, _CLOSE, _ESC = map(chr, (0xFDD0, 0xFDD1, 0xFDD2))
_ESCAPES = (
    (_ESC, _ESC + chr(0xFDD3)),
    (_OPEN, _ESC + chr(0xFDD4)),
    (_CLOSE, _ESC + chr(0xFDD5)),
)


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _escape_marks(html: Column) -> Column:
    escaped = html
    for raw, safe in _ESCAPES:
        escaped = _replace(escaped, raw, safe)
    return F.when(html.rlike(f"[{_OPEN}-{_ESC}]"), escaped).otherwise(html)


def _restore_marks(text: Column) -> Column:
    restored = text
    for raw, safe in reversed(_ESCAPES):
        restored = _replace(restored, safe, raw)
    return F.when(F.contains(text, F.lit(_ESC)), restored).otherwise(text)


def _script_free(marked: Column) -> Column:
    """Drop what stands between a script mark and the next closing one, except <a> marks."""
    opening = f"{_OPEN}!?script{_CLOSE}"
    closing = f"{_OPEN}/script{_CLOSE}"
    link_mark = f"{_OPEN}[!/]?a{_CLOSE}"

    def after_script(part: Column, is_last: Column) -> Column:
        end = F.instr(part, F.lit(closing))
        inside = F.when(end > 0, F.substring(part, F.lit(1), end - 1)).otherwise(part)
        # What follows the last tag of a page is kept even when its script stays open.
        outside = (
            F.when(end > 0, F.substring(part, end, F.length(part)))
            .when(is_last, F.substring_index(part, _CLOSE, -1))
            .otherwise(F.lit(""))
        )
        links = F.array_join(F.regexp_extract_all(inside, F.lit(link_mark), F.lit(0)), "")
        return F.concat(links, outside)

    def join_parts(parts: Column) -> Column:
        return F.array_join(
            F.transform(
                parts,
                lambda part, i: F.when(i == 0, part).otherwise(
                    after_script(part, i == F.size(parts) - 1)
                ),
            ),
            "",
        )

    cleaned = let(F.split(marked, opening, -1), join_parts)
    return F.when(marked.rlike(opening), cleaned).otherwise(marked)


def strip_tags(html: Column) -> Column:
    """HTML without tags and script bodies; link text is framed by ``[[`` and ``]]``.

    Each step is one linear pass over the page, so large pages cost what their size
    says: tags become framed names, script bodies go, links become brackets, and the
    remaining framed names are removed.
    """
    marked = F.regexp_replace(_escape_marks(html), HTML_TAG, f"{_OPEN}$1$2$3{_CLOSE}")
    text = let(marked, _script_free)
    text = _replace(text, f"{_OPEN}/a{_CLOSE}", "]]")
    text = F.regexp_replace(text, f"{_OPEN}!?a{_CLOSE}", "[[")
    text = F.regexp_replace(text, f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", "")
    return let(text, _restore_marks)


def unescape_entities(text: Column, unknown: str = "keep") -> Column:
    """Resolve the four known entities once (P4); ``&amp;`` goes last, so ``&amp;lt;`` gives ``&lt;``.

    ``unknown="error"`` raises on any other ``&name;``, ``"keep"`` leaves it as it is.
    """
    if unknown not in ("keep", "error"):
        raise ValueError(f"unknown must be 'keep' or 'error', not {unknown!r}")
    result = text
    for entity, char in ENTITIES.items():
        result = _replace(result, entity, char)
    if unknown == "error":
        message = F.concat(F.lit("Unknown entity "), F.regexp_extract(text, UNKNOWN_ENTITY, 0))
        result = F.when(text.rlike(UNKNOWN_ENTITY), F.raise_error(message)).otherwise(result)
    return result


def html_to_text(html: Column, unknown: str = "keep") -> Column:
    if unknown == "keep":
        return unescape_entities(strip_tags(html))
    return let(strip_tags(html), lambda text: unescape_entities(text, unknown))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; ``pdp-11/60`` gives itself, then ``pdp``, ``11``, ``60`` (P5)."""

    def with_parts(word: Column) -> Column:
        parts = F.concat(F.array(word), F.split(word, TOKEN_DELIMITER, -1))
        return F.when(_is_compound(word), parts).otherwise(F.array(word))

    return F.flatten(F.transform(_words(text), with_parts))


def token_bag(text: Column) -> Column:
    """The tokens of :func:`tokens` in any order, for counting: only compounds are taken apart word by word."""

    def with_parts(words: Column) -> Column:
        parts = F.split(F.array_join(F.filter(words, _is_compound), "/"), TOKEN_DELIMITER, -1)
        return F.when(F.exists(words, _is_compound), F.concat(words, parts)).otherwise(words)

    return let(_words(text), with_parts)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _is_compound(word: Column) -> Column:
    return F.contains(word, F.lit("-")) | F.contains(word, F.lit("/"))


def term_vector(token_array: Column) -> Column:
    """``array<struct<term,tf>>`` of a token array, ordered by term.

    Counting inside the row needs no shuffle: sort the tokens, keep the positions
    where a run of equal tokens starts, and take the distances between them.
    """

    def runs(ordered: Column) -> Column:
        # Nulls where a run goes on, so that each token is compared once.
        starts = F.array_compact(
            F.transform(ordered, lambda token, i: F.when((i == 0) | (token != F.get(ordered, i - 1)), i))
        )
        return let(
            starts,
            lambda begins: F.transform(
                begins,
                lambda begin, k: F.struct(
                    F.get(ordered, begin).alias("term"),
                    (F.coalesce(F.get(begins, k + 1), F.size(ordered)) - begin)
                    .cast("bigint")
                    .alias("tf"),
                ),
            ),
        )

    return let(
        F.sort_array(token_array),
        lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(
            F.array().cast("array<struct<term:string,tf:bigint>>")
        ),
    )


def title_from_page_name(name: Column) -> Column:
    return F.translate(name, "_", " ")


def normalize_title(title: Column) -> Column:
    """Tokens of the title without its parenthesised parts, joined by spaces."""
    return F.array_join(tokens(F.regexp_replace(title, PARENTHESES, "")), " ")


def dump_categories(wikitext: Column) -> Column:
    """Lower-cased names of all ``[[Category:...]]`` links joined by ``|``."""
    return F.lower(F.array_join(F.regexp_extract_all(wikitext, F.lit(DUMP_CATEGORY), F.lit(1)), "|"))


def site_categories(text: Column) -> Column:
    """Names in the category line of an extracted page joined by ``|``; NULL without one."""
    line = F.regexp_extract(text, SITE_CATEGORIES, 1)
    return let(
        line,
        lambda found: F.when(
            found != "",
            F.array_join(F.regexp_extract_all(found, F.lit(SITE_CATEGORY), F.lit(1)), "|"),
        ),
    )
