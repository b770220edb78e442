"""Awkward documents that every operator and stage must take, and plain helpers."""

import random
import re

from pyspark.sql import Row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["ka", "lo", "mi", "ren", "ta", "su", "vel", "dor", "pin", "ex"]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n):
    """Invented words, with capitals, stops and line ends."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(word + (".\n" if i % 13 == 12 else ","[: i % 7 == 6]))
    return " ".join(out)


def edited(text, places):
    """A near copy: single words replaced."""
    parts = text.split(" ")
    for p in places:
        parts[p] = f"changed{p}"
    return " ".join(parts)


def awkward(extra=()):
    """``(doc_id, text, lang, source)``: nulls, empty, blank, very long, ties and repeated rows."""
    long_text = prose(1, 9000)
    base, other = prose(2, 120), prose(3, 160)
    rows = [
        (1, base, "xx", "a"), (2, base, "xx", "a"), (2, base, "xx", "a"), (3, edited(base, [50]), "xx", None),
        (4, None, "xx", "a"), (5, "", None, "b"), (6, " \n\t ", "yy", "b"), (7, "one", "yy", ""),
        (None, base, "xx", "b"), (8, other + "\n" + base, None, "c"), (9, long_text, "yy", "c"), (10, long_text + " tail", "yy", "c"),
        (11, "né à l'été 東京 \U0001f600 " * 30, "yy", "é"), (12, "dup line here with quite a few words in it\n" * 4, "xx", "b"),
        (13, other, "yy", "a"), (14, "\n\n" + other.upper(), "yy", "a"), (15, prose(4, 300), "xx", "b"),
    ]
    return rows + list(extra)


SCHEMA = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows=None, clashing=True):
    """The rows as a table, with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if clashing:
        for name in ("size", "h", "t", "sid", "n", "score", "kept", "shard", "mix", "mix_size", "doc", "spans", "_plan"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df.repartition(3)


def collected(df):
    """Rows as sorted tuples; null first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, str(type(x)), x if not isinstance(x, list) else str(x)) for x in r])


def documents(spark, tmp_path, rows):
    """A folder with a ``documents`` table, as a registered query reads it."""
    frame(spark, rows, clashing=False).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


__all__ = ["Row", "awkward", "collected", "documents", "edited", "frame", "lower", "prose", "words"]
