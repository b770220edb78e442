"""Periodic runs in the words of a text: stretches that repeat themselves three times and more.

A run is a stretch with a smallest period q that no neighbouring word extends. Each run
holds a Lyndon root, the longest Lyndon word at some place under the order of the words or
its reverse. So the candidates are, at each place, the distance to the next smaller and to
the next greater suffix; both come from the ranks of a suffix tree. Each candidate is
extended to both sides by the trees of the sequence and of its reversal.

A run of length L >= ``least`` and L >= ``exponent`` * q is a stretch of L - q words found
again q words later, so all of it lies under windows of ``least - least // exponent`` words
that stand at least twice in the text. Trees are built for the unbroken stretches that such
windows cover: no run and no extension of one leaves its stretch, so the runs are those of
the whole text. Windows are compared by 64-bit hashes; a clash only lets more pass.

Defined results: a null, empty or blank text has no words and no runs, and its collapsed
text is empty. Runs are ordered by start, then period; runs of different periods may
overlap. Rows stay as they are, repeated ones and those without an id too. Texts are taken
whole: a text of w periodic words takes memory for two trees of up to 2w nodes, about 1 KB
a word. Columns other than those named are ignored, whatever they are called; an empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm import ragged
from wikisift.llm.suffix_tree import Extensions

_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _next_turns(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the next later one that is smaller, and the next that is greater; the length where there is none."""
    size = len(order)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    ranks = rank.tolist()
    smaller, greater = [size] * size, [size] * size
    falling, rising = [], []
    for i, r in enumerate(ranks):
        while falling and ranks[falling[-1]] > r:
            smaller[falling.pop()] = i
        falling.append(i)
        while rising and ranks[rising[-1]] < r:
            greater[rising.pop()] = i
        rising.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def sequence_runs(units: np.ndarray, least: int = 24, exponent: int = 3) -> np.ndarray:
    """Rows ``(start, length, period)`` of the runs of a sequence, by start and period."""
    size = len(units)
    none = np.zeros((0, 3), np.int64)
    if size < max(least, exponent):
        return none
    symbols = (np.unique(units, return_inverse=True)[1] + 1).tolist()
    ahead = Extensions(symbols)
    smaller, greater = _next_turns(ahead.order)
    place = np.arange(size)
    i = np.concatenate([place, place])
    j = np.concatenate([smaller, greater])
    likely = (j < size) & ((j - i) * exponent <= size)
    i, j = i[likely], j[likely]
    if not len(i):
        return none
    right = ahead.common(i, j)
    wide = right > (exponent - 2) * (j - i)  # so much of a run is left after the first root in it
    i, j, right = i[wide], j[wide], right[wide]
    left = np.zeros(len(i), np.int64)
    inside = np.flatnonzero(i > 0)
    if len(inside):
        behind = Extensions(symbols[::-1])
        left[inside] = behind.common(size - i[inside], size - j[inside])
    found = np.stack([i - left, j - i + left + right, j - i], axis=1)
    found = found[(found[:, 1] >= least) & (found[:, 1] >= exponent * found[:, 2])]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if len(found) else none


def _stretches(units: np.ndarray, before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each stretch under windows that stand twice and more in their document."""
    total = len(units)
    if total < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    h = np.zeros(total - window + 1, np.uint64)
    for k in range(window):
        h = h * _STEP + units[k : total - window + 1 + k]
    at = np.flatnonzero(owner[: len(h)] == owner[window - 1 :])
    keys = ragged.mix(ragged.mix(h[at]) + owner[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    at = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
    cover = np.bincount(at, minlength=total + 1) - np.bincount(at + window, minlength=total + 1)
    inside = np.cumsum(cover[:-1]) > 0
    edge = np.ones(total, bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
    opens = np.flatnonzero(edge)
    closes = np.append(opens[1:], total)
    return opens[inside[opens]], closes[inside[opens]]


def _piece_runs(piece: ragged.Piece, least: int, exponent: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Number of words of each document, and the runs of those that have any."""
    starts, ends, before = ragged.words(piece.data, piece.offsets)
    units = ragged.Hasher(piece.data).spans(starts, ends)
    found: dict[int, list[np.ndarray]] = {}
    for first, last in zip(*_stretches(units, before, least - least // exponent)):
        runs = sequence_runs(units[first:last], least, exponent)
        if len(runs):
            doc = int(np.searchsorted(before, first, side="right")) - 1
            found.setdefault(doc, []).append(runs + [first - before[doc], 0, 0])
    return np.diff(before), {doc: np.concatenate(parts) for doc, parts in found.items()}


def _collapsed(text: bytes, runs: np.ndarray | None) -> bytes:
    """The words joined by blanks, without those that a run has after its first period."""
    words = text.split()  # bytes are split at the same six blanks
    if runs is not None:
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, runs[:, 0] + runs[:, 2], 1)
        np.add.at(keep, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 24, exponent: int = 3,
) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` and the ``collapsed`` text of every row.

    A run has at least ``least`` words and ``exponent`` (2 or more) periods. In the collapsed
    text each run keeps its first period, unless another run takes words of it.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            for piece in ragged.pieces(b.column(b.num_columns - 1)):
                counts, found = _piece_runs(piece, least, exponent)
                data, bounds = piece.data.tobytes(), piece.offsets.tolist()
                collapsed = [_collapsed(data[bounds[k] : bounds[k + 1]], found.get(k)) for k in range(piece.n)]
                sizes = np.zeros(piece.n + 1, np.int32)
                for k, runs in found.items():
                    sizes[k + 1] = len(runs)
                all_runs = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros((0, 3), np.int64)
                values = pa.StructArray.from_arrays([pa.array(all_runs[:, c]) for c in range(3)], names=["start", "length", "period"])
                own = b.slice(piece.rows[0], piece.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns[:-1], pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values).cast(_RUNS),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=[*keep, "n_words", "runs", "collapsed"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: where the CRC-32 of the id ends in 0, words from some place on repeat that place's first words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("hit"), F.floor(h / 10).alias("g"))
    words = F.expr(r"CASE WHEN hit THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END")
    worded = chosen.withColumn("words", words).withColumn("n", F.expr("IF(words IS NULL, 0, size(words))"))
    placed = worded.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    planted = "array_join(transform(sequence(0, n - 1), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')"
    return placed.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {planted} ELSE text END").alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.expr("reduce(runs, CAST(NULL AS STRUCT<start:BIGINT,length:BIGINT,period:BIGINT>), "
                     "(best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))")  # fmt: skip
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
