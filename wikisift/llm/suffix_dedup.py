"""Removal of byte strings that occur more than once, by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the
corpus is removed. All suffixes of the corpus would have to be sorted by their first
``length`` bytes; these steps keep that exact and small:

1. Equal texts are one text with a number of copies.
2. Each window of ``length`` bytes is assigned to one anchor inside it: the leftmost
   smallest hash among its grams of ``gram`` bytes. Equal windows have equal anchors at
   equal places, so only windows of anchors that occur twice can be equal. About one byte
   in seventy begins an anchor, and only anchors are shuffled to find those.
3. Windows of one anchor meet in one task as snippets, the text around the anchor. What
   follows the anchors and what precedes them, backwards, are sequences of phrases cut at
   fixed distances from the anchor. One suffix array over all sequences of a task, built
   by grouping Lyndon prefixes, orders the snippets in both directions; byte-wise common
   prefixes of neighbours then give, for each place of the anchor in its window, the
   classes of windows that agree before it and after it. Two in a class are equal.
4. Anchors with more than ``chunk`` snippets are cut into chunks. A class found twice in
   a chunk is settled there; one window of each class is compared between the chunks.

Nothing is sampled or capped: a frequent passage only makes more chunks.

Defined results: a null text has no bytes. Strings never cross documents. Overlapping
copies count. Rows without an id take part like all others; rows with equal texts are
copies of each other whatever their ids. A text of any length is
taken whole. All places of a repeated string count alike, so there are no ties. An empty
table gives an empty one. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm import ragged
from wikisift.llm.lyndon import suffix_array
from wikisift.sources.tables import materialize

_PHRASE = 34
_BATCH_ROWS = 12_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _anchors(piece: ragged.Piece, length: int, gram: int):
    """Document, place, hash and window starts (first, last) of each anchor; places are within the document."""
    size = len(piece.data)
    empty = np.zeros(0, np.int64)
    if size < length:
        return empty, empty, empty.astype(np.uint64), empty, empty
    at = np.arange(size - gram + 1)
    grams = ragged.Hasher(piece.data).spans(at, at + gram)
    # Compared by 32 bits of the hash, then leftmost; the same wherever the window stands.
    low = np.uint64(0xFFFFFFFF)
    best = _sliding_min((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    anchor = (best & low).astype(np.int64)  # of each window
    owner = np.repeat(np.arange(piece.n), np.diff(piece.offsets))[: len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= piece.offsets[1:][owner])
    anchor, owner = anchor[inside], owner[inside]
    if not len(anchor):
        return empty, empty, empty.astype(np.uint64), empty, empty
    opens = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    closes = np.append(opens[1:], len(anchor)) - 1
    owner, zero = owner[opens], piece.offsets[owner[opens]]
    return owner, anchor[opens] - zero, grams[anchor[opens]], inside[opens] - zero, inside[closes] - zero


def _first_of(keys: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(keys), bool)
    mark[np.unique(keys, return_index=True)[1]] = True
    return mark


def _anchor_table(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(h, t, pos, before, after)`` of every anchor of ``texts(t, text)``: windows start ``before`` to ``after`` bytes ahead of it."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            keep = _first_of(ids)
            for piece in ragged.pieces(b.column(1)):
                owner, place, h, first, last = _anchors(piece, length, gram)
                take = keep[piece.rows[owner]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[take].view(np.int64)), pa.array(ids[piece.rows[owner[take]]]), pa.array(place[take].astype(np.int32)),
                    pa.array((place - first)[take].astype(np.int16)), pa.array((place - last)[take].astype(np.int16)),
                ], names=["h", "t", "pos", "before", "after"])

    return texts.mapInArrow(run, "h bigint, t bigint, pos int, before smallint, after smallint")


def _groups(batches, keys: int, least: int, most: int | None = None):
    """Tables of whole groups (equal first ``keys`` columns) of a sorted stream, of about ``least`` rows or more.

    With ``most``, a group of more rows than that may be cut over several tables.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if most is not None and rows - cut > most:
            cut = rows
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _distinct_rows(batches, keys: int):
    """The batches of a sorted stream without rows that equal the one before them in the first ``keys`` columns."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(keys)]
        other = np.ones(b.num_rows, bool)
        other[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        other[0] = last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        if other.any():
            yield b.filter(pa.array(other))


def _shared_anchors(anchors: DataFrame, chunk: int, least: int = 100_000) -> DataFrame:
    """Anchors that occur at two places or more, with a chunk number and whether their group has several.

    A group is read as a stream: only its last row and the number of rows so far are kept.
    Copies of a row, one of each batch that holds its text, go before groups are cut. So a
    cut group has more than ``2 * chunk`` rows in its first table, and is known to have
    several chunks there.
    """

    def run(batches):
        last, seen = None, 0  # anchor of the last row, and how many of its group came before this table
        for table in _groups(_distinct_rows(batches, 3), 1, least, 2 * chunk):
            h = table.column(0).to_numpy()
            opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(opens, len(h)))
            before = np.zeros(len(opens), np.int64)
            before[0] = seen if last is not None and h[0] == last else 0
            last, seen = h[-1], int(sizes[-1] + before[-1])
            number = (np.arange(len(h)) - np.repeat(opens - before, sizes)) // chunk
            size = np.repeat(sizes + before, sizes)
            table = table.append_column("part", pa.array(number.astype(np.int32))).append_column("several", pa.array(size > chunk))
            yield from table.filter(pa.array(size > 1)).to_batches()

    sorted_rows = anchors.repartition("h").sortWithinPartitions("h", "t", "pos")
    return sorted_rows.mapInArrow(run, "h bigint, t bigint, pos int, before smallint, after smallint, part int, several boolean")


def _snippets(shared: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Each shared anchor with the bytes of its windows."""
    lists = shared.groupBy("t").agg(F.collect_list(F.struct("h", "pos", "before", "after", "part", "several")).alias("anchors"))  # bounded by the text

    def once(batches):
        for b in batches:
            yield b.filter(pa.array(_first_of(b.column(0).to_numpy())))

    def run(batches):
        last = None
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, (t, text, anchors) in enumerate(zip(ids, b.column(1), b.column(2))):
                if t == last:
                    continue  # a copy from another batch
                last = t
                data = text.as_buffer()
                found = anchors.as_py()
                pos = np.array([a["pos"] for a in found])
                before = np.array([a["before"] for a in found])
                after = np.array([a["after"] for a in found])
                bytes_ = memoryview(data)
                cut = [bytes(bytes_[p - x : p - y + length]) for p, x, y in zip(pos, before, after)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([a["h"] for a in found]), pa.array([a["part"] for a in found], pa.int32()), pa.array([a["several"] for a in found]),
                    pa.array([t] * len(found)), pa.array(pos, pa.int32()), pa.array(before, pa.int16()), pa.array(after, pa.int16()), pa.array(cut, pa.binary()),
                ], names=["h", "part", "several", "t", "pos", "before", "after", "snippet"])

    distinct = texts.mapInArrow(once, texts.schema)
    joined = distinct.join(materialize(lists, "anchor-lists"), "t").sortWithinPartitions("t").select("t", F.col("text").cast("binary").alias("text"), "anchors")
    return joined.mapInArrow(run, "h bigint, part int, several boolean, t bigint, pos int, before smallint, after smallint, snippet binary")


def _phrases(rows: np.ndarray) -> np.ndarray:
    """Rank of each phrase of ``_PHRASE`` bytes of a byte matrix, in byte order; absent bytes come first."""
    cells = np.ascontiguousarray(rows).view(f"S{_PHRASE}")
    return np.unique(cells.ravel(), return_inverse=True)[1].reshape(cells.shape)


def _ordered(sequences: np.ndarray) -> np.ndarray:
    """Rank of each row of symbols among all suffixes of the rows' concatenation."""
    ended = np.zeros((len(sequences), sequences.shape[1] + 1), np.int64)
    ended[:, :-1] = sequences + 1
    array = np.array(suffix_array(ended.ravel().tolist()))
    rank = np.empty(len(array), np.int64)
    rank[array] = np.arange(len(array))
    return rank[:: ended.shape[1]]


def _common(rows: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in ``order``; -1 for the first of a group."""
    width = rows.shape[1]
    differ = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[group[order[1:]] != group[order[:-1]]] = -1
    return np.concatenate([[-1], shared])


def _repeated_windows(group, before, after, data, starts, copies, length: int, gram: int):
    """``[row, place]``: the window in which the row's anchor stands at ``place`` occurs again; and which windows exist; class numbers by place."""
    n, span = len(group), length - gram
    width = -(-span // _PHRASE) * _PHRASE
    reach = np.arange(width)
    ends = np.append(starts[1:], len(data))
    ahead = (starts + before + gram)[:, None] + reach
    right = np.where((ahead < ends[:, None]) & (reach < span), data[np.minimum(ahead, len(data) - 1)] + np.uint8(1), 0).astype(np.uint8)
    back = (starts + before - 1)[:, None] - reach
    left = np.where(back >= starts[:, None], data[np.maximum(back, 0)] + np.uint8(1), 0).astype(np.uint8)
    ranks = _ordered(_phrases(np.vstack([right, left])))
    orders = [np.lexsort((ranks[:n], group)), np.lexsort((ranks[n:], group))]
    shared = [_common(right, orders[0], group), _common(left, orders[1], group)]
    exists = (np.arange(span + 1) >= after[:, None]) & (np.arange(span + 1) <= before[:, None])
    twice = np.zeros_like(exists)
    first = np.zeros_like(exists)
    classes = np.empty(n, np.int64), np.empty(n, np.int64)
    for place in range(span + 1):
        rows = np.flatnonzero(exists[:, place])
        if not len(rows):
            continue
        classes[0][orders[0]] = np.cumsum(shared[0] < span - place)
        classes[1][orders[1]] = np.cumsum(shared[1] < place)
        key = classes[0][rows] * (n + 1) + classes[1][rows]
        _, at, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        several = count[inverse] > 1
        twice[rows, place] = several | (copies[rows] > 1)
        first[rows[at], place] = True
    return exists, twice, first


def _runs(t, pos, mask):
    """Runs of neighbouring window starts: text, first and last start."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, low = np.nonzero(change == 1)
    high = np.nonzero(change == -1)[1] - 1
    return t[row], pos[row] - high, pos[row] - low


def _settle(snippets: DataFrame, length: int, gram: int) -> DataFrame:
    """``(t, first, last, print)``: repeated windows by their starts, or, with ``print``, single windows to compare between chunks."""

    def run(batches):
        for table in _groups(batches, 2, _BATCH_ROWS):
            keys = [table.column(i).to_numpy() for i in (0, 1, 3, 4)]
            # A text whose copies went through several tasks brings the same snippets again.
            again = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            table = table.filter(pa.array(np.concatenate([[True], ~again])))
            h, part, several, t, pos, before, after = (table.column(i).to_numpy() for i in range(7))
            pos, before, after = pos.astype(np.int64), before.astype(np.int64), after.astype(np.int64)
            group = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]))
            bytes_ = table.column(7).combine_chunks()
            bytes_ = bytes_.cast(pa.large_binary())
            offsets = np.frombuffer(bytes_.buffers()[1], np.int64)[bytes_.offset : bytes_.offset + len(h) + 1]
            data = np.frombuffer(bytes_.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            hasher = ragged.Hasher(data)
            whole = hasher.spans(offsets[:-1], offsets[1:])
            # Equal snippets of a group are one with copies.
            order = np.lexsort((after, before, whole, group))
            same = np.zeros(len(h), bool)
            a, b = order[1:], order[:-1]
            same[1:] = (group[a] == group[b]) & (whole[a] == whole[b]) & (before[a] == before[b]) & (after[a] == after[b])
            number = np.empty(len(h), np.int64)
            number[order] = np.cumsum(~same) - 1
            one = order[~same]  # first row of each distinct snippet
            copies = np.bincount(number)
            cut = offsets[one], offsets[one + 1]
            lengths = cut[1] - cut[0]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            source = np.repeat(cut[0] - starts, lengths) + np.arange(lengths.sum())
            exists, twice, first = _repeated_windows(group[one], before[one], after[one], data[source], starts, copies, length, gram)
            t_, first_, last_ = _runs(t, pos, twice[number])
            names = ["t", "first", "last", "print"]
            yield pa.RecordBatch.from_arrays([pa.array(t_), pa.array(first_.astype(np.int32)), pa.array(last_.astype(np.int32)), pa.nulls(len(t_), pa.int64())], names=names)
            open_ = exists & several[one][:, None] & (first | ~twice)
            row, place = np.nonzero(open_)
            if len(row):
                at = cut[0][row] + before[one][row] - place
                start = (pos[one][row] - place).astype(np.int32)
                marks = hasher.spans(at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t[one][row]), pa.array(start), pa.array(start), pa.array(marks)], names=names)

    sorted_rows = snippets.repartition("h", "part").sortWithinPartitions("h", "part", "t", "pos")
    return sorted_rows.mapInArrow(run, "t bigint, first int, last int, print bigint")


def repeated_windows(texts: DataFrame, length: int, gram: int, chunk: int, least: int = 100_000) -> DataFrame:
    """``(t, first, last)``: starts of the windows of distinct ``texts(t, text)`` that occur elsewhere too."""
    shared = materialize(_shared_anchors(_anchor_table(texts, length, gram), chunk, least), "shared-anchors")
    found = materialize(_settle(_snippets(shared, texts, length), length, gram), "windows")
    between = found.where("print IS NOT NULL")
    twice = materialize(between.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "prints")
    return found.where("print IS NULL").union(between.join(twice, "print").select("t", "first", "last", "print")).select("t", "first", "last")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 64, chunk: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, removed, kept)`` of every row: removed byte runs and the remaining bytes."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.lit(1), F.col(text)).alias("t"), F.col(text).alias("text"))
    long_rows = rows.where(F.octet_length("text") >= length)
    copies = long_rows.groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    starts = repeated_windows(long_rows.select("t", "text"), length, gram, chunk)
    starts = starts.groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("starts"))  # bounded by the text
    notes = materialize(copies.join(starts, "t", "left").where("copies > 1 OR starts IS NOT NULL"), "text-notes")
    joined = rows.join(notes, "t", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "copies", "starts")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for text, copies, starts in zip(*(b.column(i) for i in (1, 2, 3))):
                data = text.as_py() or b""
                if (copies.as_py() or 0) > 1:
                    runs = [(0, len(data))]
                else:
                    runs = []
                    for s in sorted(starts.as_py() or (), key=lambda s: s["first"]):
                        if runs and s["first"] <= runs[-1][1]:
                            runs[-1] = runs[-1][0], max(runs[-1][1], s["last"] + length)
                        else:
                            runs.append((s["first"], s["last"] + length))
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(runs), [{"start": i, "end": j} for i, j in runs], kept))
            size, gone, n, runs, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in (size, gone, n)], pa.array(runs, spans), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:int,end:int>>, kept binary")


def op1_suffix_dedup(spark, sf_dir):
    found = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
