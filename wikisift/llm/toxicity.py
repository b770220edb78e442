"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words (letters only, ASCII lower-cased) and their runs of five
bytes, bounded by blanks, hashed into ``2**_CELL_BITS`` cells; a text has a term or has it
not. Spark counts the cells by label and keeps those whose presence goes with the label
beyond chance, at most ``max_terms`` of them. The machine over these terms has a weight for
each and a vector of ``rank`` factors, whose products weigh pairs of terms that occur
together: score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>). It is fitted by full-batch
gradient steps: tasks sum the gradients of their rows, the driver adds up one vector of
fixed size from each of a bounded number of tasks, and broadcasts the next weights.

The model learns from a sample of about ``sample_docs`` labelled documents, picked by a
hash of the id (all of them where there are fewer). Scoring reads nothing but the text,
whole; presence makes long texts no different from short ones.

Defined results: a null, empty or letterless text has the score of a text without terms.
A document with several labels counts as toxic if one of them says so; null labels and ids
are not learned from. Without any label every score is 0; with labels of one class it is
their smoothed share. Repeated rows give repeated rows, each is learned from; a tie at 0.5
is predicted 1. An empty table gives an empty one. Columns other than those named are
ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm import ragged
from wikisift.llm.language import fold
from wikisift.sources.tables import materialize

_CELL_BITS = 21
_GRAM = 5
_DOCS_PER_TASK = 2500
_WORD_SALT = np.uint64(0x51ED270B2F6E4C15)


@dataclass
class FactorizationMachine:
    """``cells`` are the hashed terms, ascending; row i of ``factors`` belongs to cell i."""

    cells: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, terms: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each of ``count`` texts, and the sum of the factors of its terms."""
        sums = np.stack([np.bincount(owner, f[terms], count) for f in self.factors.T], axis=1) if self.factors.size else np.zeros((count, 0))
        own = np.bincount(owner, (self.factors[terms] ** 2).sum(axis=1), count)
        return self.bias + np.bincount(owner, self.weights[terms], count) + ((sums * sums).sum(axis=1) - own) / 2, sums


def _word_cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of some words, and the word of each: one for the whole, one for each run of bytes with a blank on either side."""
    shift = np.uint64(64 - _CELL_BITS)
    whole = (ragged.mix(keys ^ _WORD_SALT) >> shift).astype(np.int64)
    counts = np.maximum(ends - starts + 3 - _GRAM, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    at = np.repeat(starts, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) - 1
    code = np.zeros(len(owner), np.uint64)
    low, high = starts[owner], ends[owner]
    for k in range(_GRAM):
        place = at + k
        byte = data[np.clip(place, 0, len(data) - 1)] if len(data) else place
        code = (code << np.uint64(8)) | np.where((place >= low) & (place < high), byte, 0x20).astype(np.uint64)
    return np.concatenate([whole, (ragged.mix(code) >> shift).astype(np.int64)]), np.concatenate([np.arange(len(starts)), owner])


def _terms(piece: ragged.Piece, cells: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of each document once, and the document of each: cells, or places in ``cells`` of those that occur there."""
    folded = ragged.LETTERS_ONLY[piece.data]
    starts, ends, before = ragged.words(folded, piece.offsets)
    keys, first, inverse = np.unique(ragged.Hasher(folded).spans(starts, ends), return_index=True, return_inverse=True)
    found, word = _word_cells(folded, starts[first], ends[first], keys)
    if cells is not None:
        at = np.minimum(np.searchsorted(cells, found), max(len(cells) - 1, 0))
        known = cells[at] == found if len(cells) else np.zeros(len(found), bool)
        found, word = at[known], word[known]
    order = np.argsort(word, kind="stable")
    found = found[order]
    per_word = np.bincount(word, minlength=len(keys))
    opens = np.cumsum(per_word) - per_word
    owner = np.repeat(np.arange(piece.n), np.diff(before))
    if cells is not None:
        rich = per_word[inverse] > 0
        owner, inverse = owner[rich], inverse[rich]
    held = np.unique(owner * max(len(keys), 1) + inverse)  # each word of a document once
    owner, inverse = held // max(len(keys), 1), held % max(len(keys), 1)
    counts = per_word[inverse]
    doc = np.repeat(owner, counts)
    term = found[np.repeat(opens[inverse], counts) + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)]
    both = np.unique((doc << _CELL_BITS) | term)
    return both & ((1 << _CELL_BITS) - 1), both >> _CELL_BITS


def _count_cells(batches):
    """Texts that have a cell, by label, of a whole task."""
    counts = np.zeros((2, 1 << _CELL_BITS), np.int64)
    for b in batches:
        labels = b.column(1).to_numpy(zero_copy_only=False)
        for piece in ragged.pieces(b.column(0)):
            cells, owner = _terms(piece, None)
            label = labels[piece.rows][owner]
            for y in (0, 1):
                counts[y] += np.bincount(cells[label == y], minlength=1 << _CELL_BITS)
    at = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(at), 100_000):
        some = at[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["cell", "toxic", "clean"])


def _telling_cells(sample: DataFrame, toxic: int, clean: int, max_terms: int, least: float) -> np.ndarray:
    """The cells whose presence differs most between the labels, by the root of the likelihood ratio statistic."""
    counts = sample.mapInArrow(_count_cells, "cell bigint, toxic bigint, clean bigint").groupBy("cell")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(float(toxic + clean))

    def part(n, of):
        return F.when(n > 0, n * F.log(n / of)).otherwise(0.0)

    ratio = (
        part(F.col("a"), toxic * share) + part(F.col("b"), clean * share)
        + part(toxic - F.col("a"), toxic * (1 - share)) + part(clean - F.col("b"), clean * (1 - share))
    )
    best = counts.withColumn("g", 2 * ratio).where(F.col("g") >= least * least).orderBy(F.desc("g"), "cell").limit(max_terms)
    return np.sort(np.array([r["cell"] for r in best.select("cell").collect()], np.int64))


def _feature_rows(sample: DataFrame, cells: np.ndarray) -> DataFrame:
    """``(terms, label, n)``: the terms of the texts as numbers, equal ones together."""
    shared = sample.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for b in batches:
            for piece in ragged.pieces(b.column(0)):
                terms, owner = _terms(piece, shared.value)
                bounds = np.searchsorted(owner, np.arange(piece.n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(terms.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, b.column(1).slice(piece.rows[0], piece.n)], names=["terms", "label"])

    return sample.mapInArrow(run, "terms array<int>, label int").groupBy("terms", "label").agg(F.count(F.lit(1)).alias("n"))


def _gradient(rows: DataFrame, model: FactorizationMachine) -> np.ndarray:
    """Sum over all rows of the gradient of the log loss: bias, weights, factors."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        size, rank = m.factors.shape
        total = np.zeros(1 + size + size * rank)
        for b in batches:
            lists = b.column(0)
            counts = np.diff(lists.offsets.to_numpy())
            terms, owner = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(counts)), counts)
            logit, sums = m.logits(terms, owner, len(counts))
            g = (_sigmoid(logit) - b.column(1).to_numpy()) * b.column(2).to_numpy()
            total[0] += g.sum()
            total[1 : 1 + size] += np.bincount(terms, g[owner], size)
            for f in range(rank):
                pull = g[owner] * (sums[owner, f] - m.factors[terms, f])
                total[1 + size + f * size : 1 + size + (f + 1) * size] += np.bincount(terms, pull, size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    parts = sorted(rows.mapInArrow(run, "part bigint, total binary").collect(), key=lambda r: r["part"])
    shared.destroy()
    return np.sum([np.frombuffer(r["total"]) for r in parts], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def fit(rows: DataFrame, cells: np.ndarray, n: int, toxic: int, rank: int, rounds: int, step: float, decay: float) -> FactorizationMachine:
    """Minimise the mean log loss over ``rows(terms, label, n)`` plus ``decay`` times the squares, by Adam's steps."""
    size = len(cells)
    rng = np.random.Generator(np.random.PCG64(11))
    bias = np.log((toxic + 0.5) / (n - toxic + 0.5))
    value = np.concatenate([[bias], np.zeros(size), rng.normal(0, 0.05, size * rank)])
    mean, square = np.zeros(len(value)), np.zeros(len(value))

    def model():
        return FactorizationMachine(cells, float(value[0]), value[1 : 1 + size], value[1 + size :].reshape(rank, size).T)

    for t in range(1, rounds + 1):
        gradient = _gradient(rows, model()) / n
        gradient[1:] += decay * value[1:]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        value = value - step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return model()


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 20_000,
    max_terms: int = 4096, least: float = 4.5, rank: int = 8, rounds: int = 40, step: float = 0.1, decay: float = 1e-5,
) -> FactorizationMachine:
    """Learn from the rows of ``docs`` that ``labels`` calls 1 or 0, within the bounds of the module docstring."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key"))
    known = materialize(known.agg((F.max(label) > 0).cast("int").alias("label")), "labels")
    share = min(1.0, sample_docs / max(known.count(), 1))
    chosen = known.where(F.xxhash64("key") <= min(int(2**64 * share) - 2**63, 2**63 - 1))  # about sample_docs ids, so it may be broadcast
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("text", "label")
    sample = materialize(sample.repartition(max(-(-sample_docs // _DOCS_PER_TASK), 1)), "labelled-sample")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    empty = np.zeros((0, rank))
    if not n:
        return FactorizationMachine(np.zeros(0, np.int64), -np.inf, np.zeros(0), empty)
    cells = _telling_cells(sample, toxic, n - toxic, max_terms, least) if 0 < toxic < n else np.zeros(0, np.int64)
    if not len(cells):
        return FactorizationMachine(cells, float(np.log((toxic + 0.5) / (n - toxic + 0.5))), np.zeros(0), empty)
    return fit(materialize(_feature_rows(sample, cells).coalesce(8), "features"), cells, n, toxic, rank, rounds, step, decay)


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, 0 to 1, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        m = shared.value
        for b in batches:
            scores = [np.zeros(0)]
            for piece in ragged.pieces(b.column(b.num_columns - 1)):
                scores.append(_sigmoid(m.logits(*_terms(piece, m.cells), piece.n)[0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(scores))], names=[*keep, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, score double")


def op11_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model = train(docs, labels.where(fold() != 0))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
