"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are compared as sequences of lower-cased letters and digits;
everything else is left out, so case, punctuation and spacing do not hide a passage. An
item of m characters may occur with k = ``error_rate`` * m edits. Such an occurrence
shares at least m + 1 - q * (k + 1) q-grams with the item, all within k diagonals of each
other. Shared q-grams are counted in overlapping bands of diagonals, a text's bands that
reach this number are aligned with the item inside the band, and occurrences within k
edits are returned. k is lowered for short items until the lemma asks for a q-gram.

The benchmark is taken in blocks of at most ``block_bytes`` of text, which are the only
thing that is sent to all executors; each block is one pass over all documents.

Defined results: null and empty texts, and items of fewer than q letters and digits,
match nothing. Of several occurrences of an item in a document the best is returned, the
first of equal ones. Repeated rows give repeated results; a null id is returned as it is.
A text of any length is searched whole, in slices of bounded size where it shares much
with many items. An empty table, of documents or items, gives an empty result. Columns other
than those named are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm import ragged

_TABLE_BITS = 22
_MOST_TABLE_BITS = 26
_TOGETHER = 1_000_000
_UNICODE = 0x110000
_GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _folded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits of a UTF-8 text, and the code point at which each stands."""
    if not _tables:
        lower = np.zeros(_UNICODE, np.uint32)
        for code in range(_UNICODE):
            char = chr(code)
            if char.isalnum():
                lower[code] = ord(char.lower()[0])
        _tables["lower"] = lower
    codes = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    folded = _tables["lower"][codes]
    at = np.flatnonzero(folded)
    return folded[at], at


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place that has one."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    total, done, step, h = codes.astype(np.uint64), 0, 1, None
    rest = q
    while rest:  # doubling: a gram of 2n is made of two of n
        if rest & 1:
            if h is None:
                h = total
            else:
                size = len(codes) - done - step + 1
                h = h[:size] * _GRAM_BASE**step + total[done : done + size]
            done += step
        rest >>= 1
        if rest:
            size = len(codes) - 2 * step + 1
            total = total[:size] * _GRAM_BASE**step + total[step : step + size]
            step *= 2
    return ragged.mix(h[: len(codes) - q + 1])


@dataclass
class Items:
    """A block of benchmark items with an index of their q-grams."""

    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray  # edits allowed
    need: np.ndarray  # shared q-grams asked for
    table: np.ndarray  # which hash prefixes occur
    grams: np.ndarray  # distinct, sorted
    places: np.ndarray  # by q-gram and item: number of the q-gram, item
    gram_at: np.ndarray
    q: int

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (len(self.table).bit_length() - 1))


def prepare(rows: list[tuple], q: int, error_rate: float) -> Items:
    """Index a block of ``(item_id, text)``."""
    kept = [(i, _folded((t or "").encode())[0]) for i, t in rows]
    kept = [(i, c) for i, c in kept if len(c) >= q]
    sizes = np.array([len(c) for _, c in kept], np.int64)
    budget = np.minimum((sizes * error_rate).astype(np.int64), sizes // q - 1)
    grams = [_grams(c, q) for _, c in kept]
    flat = np.concatenate([np.zeros(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
    at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(flat, kind="stable")  # items stay in order inside a q-gram
    distinct, number = np.unique(flat[order], return_inverse=True)
    bits = min(max((8 * len(flat)).bit_length(), _TABLE_BITS), _MOST_TABLE_BITS)  # a few q-grams to each hundred slots
    table = np.zeros(1 << bits, bool)
    table[(flat >> np.uint64(64 - bits)).astype(np.int64)] = True
    places = (number.astype(np.int64) << 32) | item[order]
    return Items([i for i, _ in kept], [c for _, c in kept], budget, sizes + 1 - q * (budget + 1), table, distinct, places, at[order], q)


def _align(text: np.ndarray, item: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edits between ``item`` and a part of ``text``, along diagonals ``low`` to ``high``; start and end of that part."""
    width = high - low + 1
    band = np.arange(width)
    far = np.int64(1 << 30)
    cost = np.where((band + low >= 0) & (band + low <= len(text)), 0, far)
    begin = band + low
    padded = np.zeros(len(item) + width + 1, np.int64)
    first, last = max(low, 0), min(low + len(padded), len(text))
    if last > first:
        padded[first - low : last - low] = text[first:last]
    for i, code in enumerate(item):
        step = cost + (padded[i : i + width] != code)
        place = band + low + i
        step[(place < 0) | (place >= len(text))] = far
        skip = np.append(cost[1:] + 1, far)  # an item character that the text lacks
        take = skip < step
        step = np.where(take, skip, step)
        begin = np.where(take, np.append(begin[1:], 0), begin)
        run = step - band  # text characters that the item lacks
        best = np.minimum.accumulate(run)
        origin = np.maximum.accumulate(np.where(run == best, band, 0))
        ends = band + low + i + 1
        cost = np.where((ends >= 0) & (ends <= len(text)), np.minimum(best + band, far), far)
        begin = begin[origin]
    at = int(cost.argmin())
    return int(cost[at]), int(begin[at]), at + low + len(item)


def _bands(doc, place, slot, items: Items):
    """``(document, item, band)`` keys, sorted, and how many q-grams each has, of pairs of places."""
    item = items.places[slot] & 0xFFFFFFFF
    # A band is 2 * width diagonals, and one begins at every width, so k diagonals fit into one of them.
    band = (place - items.gram_at[slot]) // np.maximum(items.budget[item], 4)
    key = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
    return _summed(key, np.ones(key.shape[1], np.int64))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(n):
        return key, n
    order = np.lexsort(key[::-1])
    key, n = key[:, order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    return key[:, first], np.add.reduceat(n, first)


def _expanded(doc, place, low, count, items: Items):
    """Bands of some places and all their places in items, in slices of bounded size."""
    key, n = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < len(count):
        last = max(int(np.searchsorted(before, before[first] + _TOGETHER, side="right")) - 1, first + 1)
        c = count[first:last]
        slot = np.repeat(low[first:last] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        more, m = _bands(np.repeat(doc[first:last], c), np.repeat(place[first:last], c), slot, items)
        key, n = _summed(np.concatenate([key, more], axis=1), np.concatenate([n, m])) if len(n) else (more, m)
        first = last
    return key, n


def _candidates(piece: ragged.Piece, grams: np.ndarray, starts: np.ndarray, items: Items):
    """``(document, item, band)`` with as many q-grams as the lemma asks for.

    Many places are worked off by documents, and those of one document by ranges of items,
    so that what is held at once stays small however often a q-gram occurs on either side.
    """
    hits = np.flatnonzero(items.table[(grams >> items.shift).astype(np.int64)])
    number = np.minimum(np.searchsorted(items.grams, grams[hits]), max(len(items.grams) - 1, 0))
    known = items.grams[number] == grams[hits] if len(items.grams) else np.zeros(len(hits), bool)
    hits, number = hits[known], number[known].astype(np.int64) << 32
    if not len(hits):
        return
    doc = np.searchsorted(starts, hits, side="right") - 1
    place = hits - starts[doc]

    def enough(some, low, count):
        key, n = _expanded(doc[some], place[some], low, count, items)
        yield from key[:, n >= items.need[key[1]]].T.tolist() if len(n) else ()

    low, high = np.searchsorted(items.places, number), np.searchsorted(items.places, number + (1 << 32))
    before = np.concatenate([[0], np.cumsum(high - low)])
    opens = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
    d = 0
    while d < len(opens) - 1:
        first = opens[d]
        e = max(int(np.searchsorted(before[opens], before[first] + _TOGETHER, side="right")) - 1, d + 1)
        some = slice(first, opens[e])
        total = int(before[opens[e]] - before[first])
        parts = max(min(-(-total // _TOGETHER), len(items.ids)), 1)
        bounds = np.linspace(0, len(items.ids), parts + 1).astype(np.int64)
        for i, j in zip(bounds[:-1], bounds[1:]):
            a, b = (low[some], high[some]) if parts == 1 else (np.searchsorted(items.places, number[some] + x) for x in (i, j))
            yield from enough(some, a, b - a)
        d = e


def _matches(piece: ragged.Piece, items: Items):
    """``(document, item, edits, start, end)`` in code points, of one piece."""
    codes, at = _folded(piece.data.tobytes())
    characters = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
    starts = np.searchsorted(at, characters[piece.offsets])  # of documents, among the folded characters
    grams = _grams(codes, items.q)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, b in _candidates(piece, grams, starts, items):
        k, w = int(items.budget[i]), max(int(items.budget[i]), 4)
        text = codes[starts[d] : starts[d + 1]]
        edits, begin, end = _align(text, items.codes[i], b * w - k, (b + 2) * w + k)
        if edits <= k and end > begin:
            best[d, i] = min(best.get((d, i), (edits, begin, end)), (edits, begin, end))
    found = []
    for (d, i), (edits, begin, end) in sorted(best.items()):
        zero = characters[piece.offsets[d]]
        found.append((d, i, edits, int(at[starts[d] + begin] - zero), int(at[starts[d] + end - 1] - zero) + 1))
    return found


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark's rows in blocks of a bounded size."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(-(-2 * total // block_bytes), 1)
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    q: int = 8, error_rate: float = 0.08, block_bytes: int = 16 << 20,
) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)`` of every benchmark item found in a document."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    names = ["doc_id", "item_id", "edits", "start", "end"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, start int, `end` int"
    found = None
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(block, q, error_rate))

        def run(batches, shared=shared):
            for b in batches:
                for piece in ragged.pieces(b.column(1)):
                    hits = _matches(piece, shared.value)
                    if hits:
                        d, i, edits, start, end = zip(*hits)
                        yield pa.RecordBatch.from_arrays([
                            b.column(0).take(pa.array(piece.rows[list(d)])), pa.array([shared.value.ids[x] for x in i]),
                            *[pa.array(x, pa.int32()) for x in (edits, start, end)],
                        ], names=names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = 8, error_rate: float = 0.08, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item."""
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(block, q, error_rate))

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for piece in ragged.pieces(b.column(at)):
                    for hit in _matches(piece, shared.value):
                        keep[piece.rows[hit[0]]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
