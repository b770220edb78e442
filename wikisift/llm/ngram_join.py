"""Exact Jaccard self-join of documents over sets of word n-grams.

The product of the document by n-gram incidence matrix with its transpose holds all
overlap counts. It is never formed whole: an n-gram is a block, the documents that hold
it. Sizes bound what a block must look at. With threshold t, two linked documents of
sizes x and y share at least t/(1+t)*(x+y) n-grams, and t*x <= y <= x/t. So in any common
order of all n-grams they share one of the first x-ceil(t*x)+1 of the one and the first
y-ceil(t*y)+1 of the other. A common n-gram at places i and j leaves at most
min(x-i, y-j) common ones from there on; where that is too few, the pair has met before
or is not linked, and the block passes it over. The counts accumulated over the other
blocks, plus all that can be left behind the last of them, discard most pairs; the rest
get their overlap counted in full.

N-grams are ordered by how often they occur, rare ones first, so that what many documents
share makes few candidates. The counts are a sketch of fixed size summed over all tasks:
any common order gives the same result, the sketch only makes it a good one.

The result is the set of connected components, so pairs inside one component need not be
looked at twice. Each document is first compared with ``_NEIGHBOURS`` documents that stand
before it in its blocks (linear work, which merges large groups of copies), then only
documents of different components. Only what has hardly an n-gram of its own meets in
large blocks; these are cut into parts, and each pair of parts is a task's work of bounded
size. No pair is dropped anywhere.

Documents with equal sets are one row (``sid``) from the first scan on. Sets and n-grams
are known by 64-bit hashes.

Defined results: a null or empty text, or one without a word, has size 0 and is linked
with nothing; a text with fewer than n words is one n-gram. A row without an id keeps its
row, with a null component, and links nobody. Rows with the same id are one node. A
text of any length is taken whole. Pairs at the very threshold are linked; which of equal
candidates are compared first does not show in the result. An empty table gives an empty
one. Columns other than those named are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikisift.llm import ragged
from wikisift.llm.graph import components, forest
from wikisift.sources.tables import materialize

_FILTER_BITS = 23
_BLOCK_ROWS = 4096
_LOT_NGRAMS = 100_000
_PART_ROWS = 100_000
_SKETCH_BITS = 22
_SKETCH_PART = 1 << 16
_MOST = 0xFFFF
_NEIGHBOURS = 4
_SIGNATURE_BITS = 1024
_PAIRS = "a bigint, b bigint, na bigint, nb bigint, c bigint, rest bigint"


def _sets(piece: ragged.Piece, n: int):
    """Distinct n-gram hashes of each document, ascending, their owner, and set sizes and hashes."""
    data = ragged.lower_ascii(piece.data)
    starts, ends, before = ragged.words(data, piece.offsets)
    grams, owner = ragged.ngrams(ragged.word_hashes(data, starts, ends), before, n)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        first = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
        grams, owner = grams[first], owner[first]
    sizes = np.bincount(owner, minlength=piece.n)
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(ragged.mix(grams), out=sums[1:])
    ends = np.cumsum(sizes)
    sids = ragged.mix((sums[ends] - sums[ends - sizes]) ^ ragged.mix(sizes.astype(np.uint64)))
    return grams, owner, sizes, sids.view(np.int64)


def _once(sids: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Marks the first document of each non-empty set that is not in ``seen``, and adds these sets."""
    mark = np.zeros(len(sids), bool)
    mark[np.unique(sids, return_index=True)[1]] = True
    mark &= (sizes > 0) & ~np.fromiter((s in seen for s in sids.tolist()), bool, len(sids))
    seen.update(sids[mark].tolist())
    return mark


def _overlap_bound(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with a set at least as small as the threshold allows: ceil(t * size)."""
    return -(-(sizes * percent) // 100)


def _signatures(grams: np.ndarray, owner: np.ndarray, count: int) -> pa.Array:
    """A bitmap of each set. A bit that only one of two sets has stands for an n-gram that only that one has."""
    flags = np.zeros((count, _SIGNATURE_BITS), bool)
    flags[owner, (grams & np.uint64(_SIGNATURE_BITS - 1)).astype(np.int64)] = True
    width = _SIGNATURE_BITS // 8
    bounds = np.arange(count + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(bounds), pa.py_buffer(np.packbits(flags, axis=1))])


def set_table(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Every row as ``(doc_id, n_shingles, sid, bits)``, and rows of ``(part, bits)``: how often n-grams come up.

    The counters of a task have one byte each, so they stop at 255; they only order n-grams.
    """

    def run(batches):
        names = ["doc_id", "n_shingles", "sid", "part", "bits"]
        counters, kind = np.zeros(1 << _SKETCH_BITS, np.uint32), None
        for b in batches:
            seen: set[int] = set()
            kind = b.column(0).type
            for piece in ragged.pieces(b.column(1)):
                grams, owner, sizes, sids = _sets(piece, n)
                np.add.at(counters, (grams[_once(sids, sizes, seen)[owner]] >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64), np.uint32(1))
                own = [b.column(0).slice(piece.rows[0], piece.n), pa.array(sizes.astype(np.int64)), pa.array(sids)]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(piece.n, pa.int32()), _signatures(grams, owner, piece.n)], names=names)
        counters = np.minimum(counters, 255).astype(np.uint8).reshape(-1, _SKETCH_PART)
        parts = np.flatnonzero(counters.any(axis=1))
        if len(parts):
            none = [pa.nulls(len(parts), kind), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(parts.astype(np.int32)), pa.array([counters[k].tobytes() for k in parts], pa.binary())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    scanned = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return scanned.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, sid bigint, part int, bits binary")


def _frequencies(scanned: DataFrame) -> np.ndarray:
    """The summed counters of ``set_table``, cut to 16 bits: 8 MB whatever the input."""

    def added(batches):
        at, total = None, None
        for b in batches:
            for part, counters in zip(b.column(0).to_pylist(), b.column(1)):
                if part != at:
                    if at is not None:
                        yield one(at, total)
                    at, total = part, np.zeros(_SKETCH_PART, np.int64)
                total += np.frombuffer(counters.as_buffer(), np.uint8)
        if at is not None:
            yield one(at, total)

    def one(part, total):
        data = np.minimum(total, _MOST).astype(np.uint16).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "counters"])

    rows = scanned.where("part IS NOT NULL").select("part", "bits").repartition("part").sortWithinPartitions("part")
    out = np.zeros((1 << _SKETCH_BITS) // _SKETCH_PART * _SKETCH_PART, np.uint16).reshape(-1, _SKETCH_PART)
    for r in rows.mapInArrow(added, "part int, counters binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counters"], np.uint16)
    return out.reshape(-1)


def _first_ngrams(texts: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """``(h, sid, n, pos)``: the first n-grams of each set by the broadcast ``counts``."""

    def run(batches):
        frequency = counts.value
        for b in batches:
            seen: set[int] = set()
            for piece in ragged.pieces(b.column(0)):
                grams, owner, sizes, sids = _sets(piece, n)
                rank = frequency[(grams >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)]
                grams = grams[np.lexsort((rank, owner))]  # equal ranks stay in the order of the hashes
                place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ahead = sizes - _overlap_bound(sizes, percent) + 1
                take = (place < ahead[owner]) & _once(sids, sizes, seen)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[take].view(np.int64)), pa.array(sids[owner[take]]), pa.array(sizes[owner[take]].astype(np.int32)), pa.array(place[take].astype(np.int32))],
                    names=["h", "sid", "n", "pos"],
                )

    return texts.mapInArrow(run, "h bigint, sid bigint, n int, pos int")


def _blocks(batches, width: int, most: int | None = None):
    """Whole groups of equal first column from a sorted stream, as arrays; a group may span batches.

    With ``most``, a group of more rows than that may be cut over several results.
    """
    held = None
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        if most is not None and len(columns[0]) - cut > most:
            cut = len(columns[0])
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _partnered(h, n, pos, percent: int) -> np.ndarray:
    """Marks rows that another row of their block could be linked with, as far as sizes and places tell."""
    own = (100 + percent) * (n - pos).astype(np.int64) - percent * n.astype(np.int64)
    opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    counts = np.diff(np.append(opens, len(h)))
    group = np.repeat(np.arange(len(opens)), counts)
    order = np.lexsort((own, group))
    best = order[opens + counts - 1]
    second = np.where(counts > 1, own[order[np.maximum(opens + counts - 2, 0)]], np.iinfo(np.int64).min)
    most = own[best][group]
    most[best] = second
    return (most >= percent * n) & (own >= percent * n[opens][group])  # blocks are sorted by size


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of n-grams that at least two sets hold, each set once, if they may be linked with another row there."""

    def run(batches):
        last = None  # of the rows before, as a large group comes in parts
        for h, sid, n, pos in _blocks(batches, 4, _PART_ROWS):
            goes_on = last is not None and h[0] == last[0]
            first = np.concatenate([[(h[0], sid[0]) != last], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])
            last = h[-1], sid[-1]
            h, sid, n, pos = h[first], sid[first], n[first], pos[first]
            if not len(h):
                continue
            near = np.concatenate([[goes_on], h[1:] == h[:-1], [False]])
            keep = near[1:] | near[:-1]
            open_ended = (h == h[0]) & goes_on | (h == h[-1])  # a block that may have rows in other parts
            some = np.flatnonzero(keep & ~open_ended)
            if len(some):
                fits = _partnered(h[some], n[some], pos[some], percent)
                keep[some[~fits]] = False
                some = some[fits]
                again = h[some][1:] == h[some][:-1]
                paired = np.zeros(len(some), bool)
                paired[1:] |= again
                paired[:-1] |= again
                keep[some[~paired]] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, sid, n, pos)], names=["h", "sid", "n", "pos"])

    return rows.repartition("h").sortWithinPartitions("h", "n", "sid").mapInArrow(run, "h bigint, sid bigint, n int, pos int")


def _pairs_table(a, b, na, nb, count, rest) -> pa.RecordBatch:
    """Each pair once: how often it came up, and the least that may be common elsewhere."""
    count, rest = np.broadcast_to(count, a.shape), np.broadcast_to(rest, a.shape)
    if len(a):
        order = np.lexsort((b, a))
        a, b, na, nb, count, rest = (x[order] for x in (a, b, na, nb, count, rest))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count, rest = np.add.reduceat(count, first), np.minimum.reduceat(rest, first)
        a, b, na, nb = (x[first] for x in (a, b, na, nb))
    arrays = [pa.array(x.astype(np.int64)) for x in (a, b, na, nb, count, rest)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "na", "nb", "c", "rest"])


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b, c)``: pairs whose common n-grams so far, with all that may be left, reach the threshold.

    Common n-grams have one order in both sets. So those not counted lie in blocks that
    ``rest`` allows for, or behind the last one counted, where the shorter remainder bounds them.
    """
    counted = pairs.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.sum("c").alias("c"), F.min("rest").alias("rest"))
    return counted.where((100 + percent) * (F.col("c") + F.col("rest")) >= percent * (F.col("na") + F.col("nb")))


def _neighbour_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each document with the one before it in each of its blocks, where they have enough in common.

    Blocks are ordered by size, so the two are alike in it; documents of equal size come in
    another order in every block, so a document meets different ones.
    """

    def run(batches):
        last = None  # row before, as a large group comes in parts
        for h, sid, n, pos in _blocks(batches, 4, _PART_ROWS):
            n, left = n.astype(np.int64), (n - pos).astype(np.int64)
            before = [np.concatenate([x[:1] if last is None else [y], x[:-1]]) for x, y in zip((h, sid, n, left), last or (None,) * 4)]
            last = h[-1], sid[-1], n[-1], left[-1]
            same = (before[0] == h) & (before[1] != sid)
            left = np.minimum(left, before[3])
            at = np.flatnonzero(same & ((100 + percent) * left >= percent * (n + before[2])))
            yield _pairs_table(sid[at], before[1][at], n[at], before[2][at], np.int64(1), left[at] - 1)

    rows = rows.repartition("h").sortWithinPartitions("h", "n", F.xxhash64("h", "sid"))
    return _promising(rows.mapInArrow(run, _PAIRS), percent)


def _best_pairs(pairs: DataFrame) -> DataFrame:
    """The few pairs of each document that came up most often."""
    best = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= _NEIGHBOURS).select("a", "b", "na", "nb")


def _alone(bits: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How many bits rows ``r`` have that rows ``c`` lack."""
    out = np.zeros(len(r), np.int64)
    for i in range(0, len(r), 1 << 16):
        own = bits[r[i : i + (1 << 16)]] & ~bits[c[i : i + (1 << 16)]]
        out[i : i + (1 << 16)] = np.bitwise_count(own).sum(axis=1)
    return out


def _cross_pairs(rows: DataFrame, percent: int, tile: int = 1024) -> DataFrame:
    """All pairs of one block that are of different components and can reach the threshold.

    A block of k times ``_BLOCK_ROWS`` documents is cut into k parts by a hash, and every pair
    of parts, or a part alone, is compared on its own. Bits of one signature alone count the
    n-grams that a set surely has alone, which leaves out most pairs that are not linked.
    """

    def run(batches):
        for g, sid, n, pos, comp, part, bits in _blocks(batches, 7):
            n, left_of = n.astype(np.int64), (n - pos).astype(np.int64)
            bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(n), -1)
            opens = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            found, held = [], 0
            for first, end in zip(opens[:-1], opens[1:]):
                for i in range(first, end, tile):
                    some = np.arange(i, min(i + tile, end))
                    limit = n[some[-1]] * 100 // percent
                    stop = first + int(np.searchsorted(n[first:end], limit, side="right"))
                    for j in range(i, stop, tile):
                        others = np.arange(j, min(j + tile, stop))
                        left = np.minimum(left_of[some][:, None], left_of[others][None, :])
                        fits = (others[None, :] > some[:, None]) & (comp[some][:, None] != comp[others][None, :])
                        fits &= (part[some] < 0)[:, None] | (part[some][:, None] != part[others][None, :])
                        fits &= (100 + percent) * left >= percent * (n[some][:, None] + n[others][None, :])
                        r, c = np.nonzero(fits)
                        left = left[r, c]
                        r, c = some[r], others[c]
                        most = np.minimum(n[r] - _alone(bits, r, c), n[c] - _alone(bits, c, r))
                        able = (100 + percent) * most >= percent * (n[r] + n[c])
                        r, c, left = r[able], c[able], left[able]
                        swap = sid[r] > sid[c]
                        r, c = np.where(swap, c, r), np.where(swap, r, c)
                        found.append((sid[r], sid[c], n[r], n[c], np.ones(len(r), np.int64), left - 1))
                        held += len(r)
                        if held > 200_000:
                            yield _pairs_table(*map(np.concatenate, zip(*found)))
                            found, held = [], 0
            if held:
                yield _pairs_table(*map(np.concatenate, zip(*found)))

    parts = F.ceil(F.col("block") / _BLOCK_ROWS)
    cut = rows.withColumn("part", F.pmod(F.xxhash64("sid"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    both = F.xxhash64("h", F.least("part", "other"), F.greatest("part", "other"))
    cut = cut.select(
        F.when(F.col("block") <= _BLOCK_ROWS, F.col("h")).otherwise(both).alias("g"), "sid", "n", "pos", "comp",
        F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).cast("int").alias("part"), "bits",
    )
    placed = cut.repartition("g").sortWithinPartitions("g", "n", "sid")
    return _promising(placed.mapInArrow(run, _PAIRS), percent).select("a", "b", "na", "nb")


def _within_signatures(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures leave enough in common."""

    def run(batches):
        for b in batches:
            na, nb = (b.column(i).to_numpy() for i in (2, 3))
            bits = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(len(na), -1) for i in (5, 6)]
            alone = [np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64) for x, y in (bits, bits[::-1])]
            able = (100 + percent) * np.minimum(na - alone[0], nb - alone[1]) >= percent * (na + nb)
            yield pa.RecordBatch.from_arrays(b.columns[:5], names=["a", "b", "na", "nb", "c"]).filter(pa.array(able))

    for end in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("sid").alias(end), F.col("bits").alias(f"bits_{end}")), end)
    return pairs.select("a", "b", "na", "nb", "c", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, c bigint")


def _needed_filter(sids: DataFrame):
    """A bitmap of fixed size over the hashes of ``sid``; more sets only let more pass."""
    slot = F.shiftrightunsigned("sid", 64 - _FILTER_BITS)
    words = sids.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int")).alias("bit"))
    bits = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _packed_sets(texts: DataFrame, n: int, wanted) -> DataFrame:
    """``(sid, grams)``, the hashes as bytes, of the sets that pass the bitmap ``wanted``."""

    def run(batches):
        bits = wanted.value
        for b in batches:
            seen: set[int] = set()
            for piece in ragged.pieces(b.column(0)):
                grams, owner, sizes, sids = _sets(piece, n)
                slot = sids.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)
                mark = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                take = _once(sids, sizes, seen) & (mark > 0)
                if take.any():
                    ends = np.cumsum(sizes)
                    packed = [grams[ends[i] - sizes[i] : ends[i]].tobytes() for i in np.flatnonzero(take)]
                    yield pa.RecordBatch.from_arrays([pa.array(sids[take]), pa.array(packed, pa.binary())], names=["sid", "grams"])

    return texts.mapInArrow(run, "sid bigint, grams binary")


def _in_lots(pairs: DataFrame) -> DataFrame:
    """Pairs with a ``lot``: those of one cluster together, as long as its sets are few, so that a set is moved once for them."""
    clusters = components(forest(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    placed = pairs.join(clusters.withColumnRenamed("node", "a").withColumnRenamed("component", "cluster"), "a")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.sum(F.col("na") + F.col("nb")) / _LOT_NGRAMS).alias("lots"))
    spread = F.pmod(F.xxhash64("a", "b"), F.greatest("lots", F.lit(1)))
    return materialize(placed.join(sizes, "cluster").select("a", "b", F.xxhash64("cluster", spread).alias("lot")), "lots")


def _links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` whose overlap, counted in full, reaches the threshold, as ``(a, b)``."""

    def run(batches):
        for b in batches:
            found = []
            for members, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = {m["sid"]: np.frombuffer(m["grams"], np.uint64) for m in members}
                for p in pairs:
                    x, y = held[p["a"]], held[p["b"]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((p["a"], p["b"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    spark = pairs.sparkSession
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    pairs = _in_lots(pairs)
    ends = pairs.select("lot", F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = spark.sparkContext.broadcast(_needed_filter(ends.select("sid").distinct()))
    # Sets are moved once to their name and once for each lot: no table of them is written.
    sets = _packed_sets(texts, n, wanted).dropDuplicates(["sid"])
    members = ends.join(sets, "sid").groupBy("lot").agg(F.collect_list(F.struct("sid", "grams")).alias("members"))
    wanted_pairs = pairs.groupBy("lot").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    return materialize(members.join(wanted_pairs, "lot").select("members", "pairs").mapInArrow(run, "a bigint, b bigint"), "pair-links")


def _with_components(rows: DataFrame, links: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows of blocks that still span components, with the component and the signature of each."""
    labels = components(forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    labelled = rows.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    labelled = materialize(labelled.select("h", "sid", "n", "pos", F.coalesce("component", "sid").alias("comp")), "rows")
    mixed = labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("block"))
    mixed = materialize(mixed.where("lo <> hi").select("h", "block"), "blocks")
    rows = labelled.join(mixed, "h").select("h", "sid", "n", "pos", "comp", "block")
    return rows.join(signatures, "sid")


def set_links(texts: DataFrame, scanned: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between sets that connect just what all pairs at or above the threshold connect.

    ``scanned`` is the ``set_table`` of the texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(scanned))
    rows = materialize(_shared(_first_ngrams(texts, n, percent, shared), percent), "shared")
    signatures = scanned.where("part IS NULL AND n_shingles > 0").select("sid", "bits").dropDuplicates(["sid"])
    signatures = materialize(signatures.join(rows.select("sid").distinct(), "sid", "left_semi"), "signatures")
    near = _within_signatures(_neighbour_pairs(rows, percent), signatures, percent)
    first = materialize(_best_pairs(near), "neighbours")
    links = _links(first, texts, n, percent)
    cross = _cross_pairs(_with_components(rows, links, signatures), percent)
    checked = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.union(_links(cross.join(checked, ["a", "b"], "left_anti"), texts, n, percent))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: the smallest id reachable by links.

    Two documents link when 100 times their overlap reaches ``percent`` times their union.
    """
    scanned = materialize(set_table(docs, key, text, n), "set-table")
    sets = scanned.where("part IS NULL").select("doc_id", "n_shingles", "sid")
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = materialize(named.groupBy("sid").agg(F.min("doc_id").alias("first")), "first-docs")
    links = set_links(docs.where(F.col(key).isNotNull()).select(F.col(text).alias("text")), scanned, n, percent)
    ends = forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("a"), F.col("v").alias("b"))
    for end in ("a", "b"):
        ends = ends.join(first.select(F.col("sid").alias(end), F.col("first").alias(f"doc_{end}")), end)
    labels = components(materialize(ends.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")), "doc-links"))
    labels = first.join(labels.withColumnRenamed("node", "first"), "first", "left")
    labels = materialize(labels.select("sid", F.coalesce("component", "first").alias("component_id")), "set-components")
    joined = sets.join(labels, "sid", "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", linked.alias("component_id"))


def op4_ngram_join(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
