"""Line dedup: later copies of repeated line runs are deleted.

A document is the sequence of ids of its lines that hold a word. All suffixes of all these
sequences are grouped by their first lines with distributed prefix doubling: positions
with equal lines get one name (the first position that has it, in the order of ids), and
the names of two neighbouring windows name the window of both. Doubling ends at
``min_lines``, as the LCP intervals of at least that depth are just the classes of
positions with equal windows of that length. In each class the first position stays and
the windows of the others are deleted; windows that overlap or touch join into maximal
runs. Single lines of ``long_line_words`` words or more count as runs of their own.

Names are computed by pre-aggregated minima and plain joins over repeated lines only, so
a line that a third of all documents share adds rows, never a group.

Defined results: null and empty texts have no lines and stay empty. Lines without a word
are never deleted. Null ids come first in the order. Rows with the same id and text are
one document and get the same result. A text of any length is
taken whole; an empty table gives an empty one. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm import ragged
from wikisift.sources.tables import materialize


def _line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, line, h, n_words)``: the lines with a word of ``docs(doc_id, doc, text)``, numbered from 0."""

    def run(batches):
        for b in batches:
            for piece in ragged.pieces(b.column(2)):
                starts, _, _ = ragged.words(piece.data, piece.offsets)
                breaks = np.flatnonzero(piece.data == 10)
                opens = np.sort(np.concatenate([piece.offsets[:-1], breaks + 1]))
                ends = np.sort(np.concatenate([breaks, piece.offsets[1:]]))
                owner = np.repeat(np.arange(piece.n), 1 + np.diff(np.searchsorted(breaks, piece.offsets)))
                n_words = np.searchsorted(starts, ends) - np.searchsorted(starts, opens)
                solid = n_words > 0
                opens, ends, owner, n_words = opens[solid], ends[solid], owner[solid], n_words[solid]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                h = ragged.Hasher(piece.data).spans(opens, ends)
                rows = pa.array(piece.rows[owner])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(number.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n_words.astype(np.int32))],
                    names=["doc_id", "doc", "line", "h", "n_words"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, doc bigint, line int, h bigint, n_words int")


def _named(windows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Windows that occur at several positions, with their common name and whether they are a later copy."""
    place = F.struct("doc_id", "doc", "line")
    firsts = windows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = firsts.select(*keys, F.xxhash64("first").alias("name"), F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))
    firsts = materialize(firsts, f"{label}-names")
    found = windows.join(firsts, keys)
    later = (F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line"))
    return materialize(found.select("doc_id", "doc", "line", "n_words", "name", later.alias("later")), label)


def _paired(windows: DataFrame, shift: int) -> DataFrame:
    """Windows with the name of the window that begins ``shift`` lines later, where both are repeated."""
    second = windows.select("doc", (F.col("line") - shift).alias("line"), F.col("name").alias("next"))
    return windows.join(second, ["doc", "line"]).select("doc_id", "doc", "line", "n_words", F.col("name").alias("left"), F.col("next").alias("right"))


def repeated_lines(docs: DataFrame, min_lines: int, long_line_words: int) -> DataFrame:
    """``(doc, first, length)``: windows of ``docs(doc_id, doc, text)`` that are later copies; they may overlap."""
    lines = materialize(_line_table(docs), "lines").dropDuplicates(["doc", "line"])
    windows = _named(materialize(lines, "distinct-lines"), ["h"], "line-windows")
    single = windows.where(F.col("later") & (F.col("n_words") >= (1 if min_lines == 1 else long_line_words)))
    found = single.select("doc", F.col("line").alias("first"), F.lit(1).alias("length"))
    length = 1
    while length < min_lines:
        shift = min(length, min_lines - length)
        windows = _named(_paired(windows, shift), ["left", "right"], "line-windows")
        length += shift
    if length > 1:
        found = found.union(windows.where("later").select("doc", F.col("line").alias("first"), F.lit(length).alias("length")))
    return found


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, long_line_words: int = 8) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_runs, kept)`` of every row; ``kept`` is the text without the deleted lines."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text"))
    spans = repeated_lines(rows, min_lines, long_line_words)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "length")).alias("spans"))  # bounded by the document's lines
    joined = rows.join(spans, "doc", "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = {s["first"] + k for s in spans or () for k in range(s["length"])}
                kept, number, runs, last = [], -1, 0, None
                for line in (text or "").split("\n"):
                    solid = bool(line.strip("\x20\t\n\x0b\x0c\r"))
                    number += solid
                    if solid and number in gone:
                        runs += last != number - 1
                        last = number
                    else:
                        kept.append(line)
                out.append((number + 1, len(gone), runs, "\n".join(kept)))
            n_lines, removed, runs, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in (n_lines, removed, runs)], pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_removed", "n_runs", "kept"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_removed bigint, n_runs bigint, kept string")


def op5_line_dedup(spark, sf_dir):
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
