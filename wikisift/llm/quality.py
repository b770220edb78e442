"""Quality rules: counts of each text, and how far it diverges from language references.

References are histograms over all documents of a language: characters by class, and the
language's most common words against all others. A document is compared with each by the
Jensen-Shannon distance (base 2, so 0 to 1) of both histograms and judged by the language
that fits best, whatever its label says. It is kept when the classes are within
``max_class_distance`` and the words within ``max_word_distance``; texts of fewer than
``min_words`` words are too short for a histogram and fail before that.

How far words can be apart depends on the share of a language's words that its common
words cover, and a short text is far from its own language by chance. So the distance of
the words is a share: 0 is the divergence that texts of so many words drawn from the
reference have on average, 1 that of a text with none of the common words. Where chance
alone spreads over more than a fifth of that range, as for few words of a language with
low coverage, the fifth's share is what counts, so chance rejects no text.

Counting references is one pass with partial sums per batch; what reaches the driver are
the ``common_words`` of each language that occurs.

Defined results: a null or empty text has no words and fails; with no labelled documents
there is no reference and the rules alone decide. Repeated rows give repeated results; a
null id is returned as it is. A text of any length is counted whole;
an empty table gives an empty one. Columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikisift.llm import ragged

_PIECE_BYTES = 2 << 20
# Character classes.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other")
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = -1  # not the first byte of a character
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
# Numbers of words for which chance divergences are computed; between them and beyond, by powers.
_LENGTHS = 2 ** np.arange(2, 14)
# A share of 0.6 is then three standard deviations at least.
_LEAST_RANGE = 5.0


@dataclass
class References:
    """Histograms of each language: character classes, and shares of its common words and of the rest."""

    languages: list[str]
    classes: np.ndarray
    words: np.ndarray  # sorted hashes of all common words
    columns: list[np.ndarray]  # of each language, its words
    shares: list[np.ndarray]
    none: np.ndarray  # divergence of a text with none of its common words
    usual: np.ndarray  # [language, step of _LENGTHS]: mean divergence of so many words drawn from it
    spread: np.ndarray  # and its standard deviation


def _word_keys(piece: ragged.Piece):
    folded = ragged.LETTERS_ONLY[piece.data]
    starts, ends, before = ragged.words(folded, piece.offsets)
    return folded, starts, ends, before, ragged.Hasher(folded).spans(starts, ends)


def _class_counts(piece: ragged.Piece) -> np.ndarray:
    kind = _CLASS[piece.data]
    owner = np.repeat(np.arange(piece.n), np.diff(piece.offsets))
    counted = kind >= 0
    width = len(CLASSES)
    return np.bincount(owner[counted] * width + kind[counted], minlength=piece.n * width).reshape(piece.n, width)


def build_references(docs: DataFrame, text: str = "text", lang: str = "lang", common_words: int = 64) -> References:
    """Count the references over all rows with a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    index = {name: i for i, name in enumerate(languages)}
    schema = pa.schema([("language", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            labels = np.array([index.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            for piece in ragged.pieces(b.column(0), _PIECE_BYTES):
                label = labels[piece.rows]
                _, _, _, before, keys = _word_keys(piece)
                unique, inverse = np.unique(keys, return_inverse=True)
                of = np.repeat(label, np.diff(before))
                pair, n = np.unique(inverse[of >= 0] * len(languages) + of[of >= 0], return_counts=True)
                classes = _class_counts(piece)
                total = np.zeros((len(languages), len(CLASSES)), np.int64)
                np.add.at(total, label[label >= 0], classes[label >= 0])
                lang_, class_ = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([pair % max(len(languages), 1), lang_]).astype(np.int32)),
                    pa.array(np.repeat(np.array([0, 1], np.int8), [len(pair), len(lang_)])),
                    pa.array(np.concatenate([unique[pair // max(len(languages), 1)].view(np.int64), class_])),
                    pa.array(np.concatenate([n, total[lang_, class_]])),
                ], schema=schema)

    counts = rows.mapInArrow(run, "language int, kind tinyint, key bigint, n bigint").groupBy("language", "kind", "key").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("language", "kind").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("rank", first).where(f"rank <= {common_words}").collect()
    totals = dict(rows_ for rows_ in (tuple(r) for r in counts.where("kind = 0").groupBy("language").agg(F.sum("n")).collect()))
    width = len(languages)
    classes = np.zeros((width, len(CLASSES)))
    chosen: list[list[tuple[int, int]]] = [[] for _ in languages]
    for r in top:
        if r["kind"] == 1:
            classes[r["language"], r["key"]] = r["n"]
        else:
            chosen[r["language"]].append((np.int64(r["key"]).astype(np.uint64), r["n"]))
    words = np.unique(np.array([k for c in chosen for k, _ in c], np.uint64))
    columns, shares = [], []
    for i, c in enumerate(chosen):
        n = np.array([x for _, x in c], float)
        columns.append(np.searchsorted(words, np.array([k for k, _ in c], np.uint64)))
        shares.append(np.append(n, totals.get(i, 0) - n.sum()) / max(totals.get(i, 0), 1))
    classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
    none = np.array([js_distance(np.eye(len(q))[-1:], q)[0] ** 2 for q in shares])
    chance = np.array([_chance(q) for q in shares]).reshape(width, 2, len(_LENGTHS))
    return References(languages, classes, words, columns, shares, none, chance[:, 0], chance[:, 1])


def _chance(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the divergence from ``q`` of words drawn from it, for each of ``_LENGTHS``."""
    factorials = np.concatenate([[0], np.cumsum(np.log(np.arange(1, _LENGTHS[-1] + 1)))])
    q = q[q > 0][:, None]
    mean, deviation = [], []
    for n in _LENGTHS:
        k = np.arange(n + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(k < n, (n - k) * np.log1p(-q), 0)
        chance = np.exp(factorials[n] - factorials[k] - factorials[n - k] + k * np.log(q) + rest)
        p = k / n
        part = (np.where(p > 0, p * np.log2(np.maximum(p, 1 / n) * 2 / (p + q)), 0) + q * np.log2(2 * q / (p + q))) / 2
        means = (chance * part).sum(axis=1)
        mean.append(means.sum())
        deviation.append(np.sqrt(max(((chance * part**2).sum(axis=1) - means**2).sum(), 0)))
    return np.array(mean), np.array(deviation)


def _at_length(table: np.ndarray, rows: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Values of ``table[row]`` at these numbers of words, on a straight line of logarithms."""
    at = np.log2(np.maximum(n_words, 1) / _LENGTHS[0])
    step = np.clip(at.astype(np.int64), 0, len(_LENGTHS) - 2)
    logs = np.log2(np.maximum(table, 1e-12))
    return 2 ** (logs[rows, step] + (logs[rows, step + 1] - logs[rows, step]) * (at - step))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to the distribution ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _distances(piece: ragged.Piece, refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language that fits best, the class distance to it, and the share of the word distance."""
    n = piece.n
    if not refs.languages:
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    classes = _class_counts(piece).astype(float)
    classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
    _, _, _, before, keys = _word_keys(piece)
    at = np.minimum(np.searchsorted(refs.words, keys), len(refs.words) - 1) if len(refs.words) else np.zeros(len(keys), np.int64)
    known = refs.words[at] == keys if len(refs.words) else np.zeros(len(keys), bool)
    owner = np.repeat(np.arange(n), np.diff(before))
    width = max(len(refs.words), 1)
    held = np.bincount(owner[known] * width + at[known], minlength=n * width).reshape(n, width)
    total = np.maximum(np.diff(before), 1)[:, None]
    by_class = np.stack([js_distance(classes, q) for q in refs.classes], axis=1)
    by_word = []
    for columns, share in zip(refs.columns, refs.shares):
        own = held[:, columns] / total
        by_word.append(js_distance(np.hstack([own, 1 - own.sum(axis=1, keepdims=True)]), share))
    by_word = np.stack(by_word, axis=1)
    # References of different coverage are compared by the share of what each can be away.
    shares = np.where(refs.none > 0, by_word / np.sqrt(np.maximum(refs.none, 1e-12)), 1)
    best = (by_class + shares).argmin(axis=1)
    at = np.arange(n), best
    n_words = np.diff(before)
    usual, spread = _at_length(refs.usual, best, n_words), _at_length(refs.spread, best, n_words)
    reach = np.maximum(refs.none[best] - usual, _LEAST_RANGE * spread)
    return best, by_class[at], np.maximum(by_word[at] ** 2 - usual, 0) / np.maximum(reach, 1e-12)


def text_counts(piece: ragged.Piece) -> dict[str, np.ndarray]:
    """Words, characters in words, symbols, repeated lines and words in repeated three-word windows."""
    data, offsets, n = piece.data, piece.offsets, piece.n
    starts, ends, before = ragged.words(data, offsets)
    hasher = ragged.Hasher(data)
    words = np.diff(before)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]
    # Lines: each text is cut at its line feeds.
    breaks = np.flatnonzero(data == 10)
    opens = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    after = np.sort(np.concatenate([breaks, offsets[1:]]))
    # A line feed at the end of a text opens an empty line that shares its place with the next text.
    line_doc = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(breaks, offsets)))
    solid = np.searchsorted(starts, after) > np.searchsorted(starts, opens)
    opens, after, line_doc = opens[solid], after[solid], line_doc[solid]
    lines = hasher.spans(opens, after)
    order = np.lexsort((lines, line_doc))
    same = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = np.bincount(line_doc[order][1:][same], minlength=n)
    # Three-word windows.
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        owner = np.repeat(np.arange(n), words)
        at = np.flatnonzero(owner[:-2] == owner[2:])
        units = hasher.spans(starts, ends)
        grams = ragged.mix((units[at] * np.uint64(0x9E3779B97F4A7C15) + units[at + 1]) * np.uint64(0x9E3779B97F4A7C15) + units[at + 2])
        order = np.lexsort((grams, owner[at]))
        same = (grams[order][1:] == grams[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    repeat_words = np.concatenate([[0], np.cumsum(repeated)])
    return {
        "n_words": words, "word_chars": in_words[before[1:]] - in_words[before[:-1]], "n_symbols": np.diff(symbols),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words[before[1:]] - repeat_words[before[:-1]],
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame, refs: References, key: str = "doc_id", text: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
    max_class_distance: float = 0.3, max_word_distance: float = 0.6,
) -> DataFrame:
    """Counts, best language, distances and verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", *COUNTS, "base_failed", "language", "class_distance", "word_distance", "kept"]

    def run(batches):
        refs = shared.value
        languages = np.array([*refs.languages, None], object)
        size = _PIECE_BYTES * 64 // max(len(refs.languages), 64)  # a text has a column for each common word
        for b in batches:
            for piece in ragged.pieces(b.column(1), size):
                counts = text_counts(piece)
                best, by_class, by_word = _distances(piece, refs)
                failed = (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])
                kept = ~failed & (by_class <= max_class_distance) & (by_word <= max_word_distance)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(piece.rows[0], piece.n), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(failed),
                    pa.array(languages[best], pa.string()), pa.array(by_class), pa.array(by_word), pa.array(kept),
                ], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, f"doc_id {kind}, {numbers}, base_failed boolean, language string, class_distance double, word_distance double, kept boolean")


def op8_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, build_references(docs)).select("doc_id", *COUNTS, "base_failed", "kept")
