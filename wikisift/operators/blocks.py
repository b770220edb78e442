"""Bitmaps and block maxima of posting lists: what a search can leave out before it reads postings (J2, Q-TOP).

``bitmaps(term, chunk, bits)`` holds the documents of long lists, 32,768 ids to a row, in the
form of Spark's bitmap functions. The lists of a query are intersected there, and only
postings of the remaining documents go on.

``blocks(term, shift, block, n, ...)`` cuts each list into ranges of ``2**shift`` ids with
about ``BLOCK_ROWS`` postings, and keeps the greatest weight of each kind in a range. The
sum over the terms of a query bounds the scores of a range. The ranges with the highest
bounds are searched first; the score of the last hit wanted is then a threshold, and ranges
that cannot reach it are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wikisift.operators.skew import BROADCAST_BYTES, ROWS_PER_SPLIT, fits_broadcast, join_lookup
from wikisift.sources.tables import materialize, with_bucket, write_by_term

BLOCK_ROWS = 512
BITMAP_LEAST = 4096
BITMAP_BYTES = 4096
# Ranges of document ids that are given to the scan itself; it skips the pages of others.
PUSHED_RANGES = 64


def bitmaps_of(postings: DataFrame, terms: DataFrame, least: int) -> DataFrame:
    """``(term, chunk, bits)`` of the lists with at least ``least`` documents."""
    keyed, keys = with_bucket(terms.where(F.col("df") >= least).select("term"), postings)
    long = join_lookup(postings, keyed, keys, "doc_id", fits_broadcast(keyed))
    bits = F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("doc_id")))
    return long.groupBy("term", F.call_function("bitmap_bucket_number", F.col("doc_id")).alias("chunk")).agg(bits.alias("bits"))


def _weights() -> dict[str, Column]:
    """The part of a score that a posting alone decides, by ``(tf, normalize, similarity)``."""
    raw, euclid = F.col("tf").cast("double"), F.sqrt(F.col("sum_sq").cast("double"))
    kinds = {"raw": raw, "log": F.lit(1.0) + F.log(raw), "max": F.lit(0.5) + F.lit(0.5) * raw / F.col("tf_max")}
    return kinds | {f"{name}_euc": weight / euclid for name, weight in kinds.items()}


def blocks_of(postings: DataFrame, terms: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``(term, shift, block, n)`` and the greatest weight of each kind, for every list."""
    ids = postings.agg((F.max("doc_id") + 1).alias("n"))  # ids are dense, or the ranges hold fewer postings
    width = F.greatest(F.lit(1.0), ids.scalar() * F.lit(float(rows)) / F.col("df"))
    shifts = terms.select("term", "df", F.least(F.floor(F.log2(width)), F.lit(62)).cast("int").alias("shift"))
    if fits_broadcast(shifts):
        keyed, keys = with_bucket(shifts.drop("df"), postings)
        cut = postings.join(F.broadcast(keyed), keys)
    else:
        # Only long lists are salted. The other terms, nearly the whole vocabulary, are neither copied nor broadcast.
        long = shifts.where(F.col("df") > ROWS_PER_SPLIT).drop("df")
        keyed, keys = with_bucket(long, postings)
        cut = join_lookup(postings, keyed, keys, "doc_id", fits_broadcast(keyed)).select(*postings.columns, "shift")
        short = shifts.where(F.col("df") <= ROWS_PER_SPLIT).drop("df")
        cut = cut.unionByName(postings.join(short.hint("merge"), "term").select(*postings.columns, "shift"))
    cut = cut.withColumn("block", F.call_function("shiftright", F.col("doc_id"), F.col("shift")))
    greatest = [F.max(weight).alias(name) for name, weight in _weights().items()]
    return cut.groupBy("term", "shift", "block").agg(F.count(F.lit(1)).alias("n"), *greatest)


def write_blocks(index, path: str, buckets: int, least: int = BITMAP_LEAST, rows: int = BLOCK_ROWS) -> None:
    """Write both tables of a stored index, by term."""
    write_by_term(bitmaps_of(index.postings, index.terms, least), f"{path}/bitmaps", ["term", "chunk"], buckets)
    write_by_term(blocks_of(index.postings, index.terms, rows), f"{path}/blocks", ["term", "block"], buckets)


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.ascii(F.decode(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def candidates(weighted: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(query_id, chunk, bits)``: documents that all lists of a query with bitmaps hold."""
    keyed, keys = with_bucket(weighted.select("query_id", "term"), bitmaps)
    found = bitmaps.join(F.broadcast(keyed), keys).select("query_id", "chunk", "term", "bits")
    lists = found.select("query_id", "term").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("lists"))
    both = found.groupBy("query_id", "chunk").agg(F.call_function("bitmap_and_agg", F.col("bits")).alias("bits"), F.count(F.lit(1)).alias("held"))
    return both.join(F.broadcast(lists), "query_id").where((F.col("held") == F.col("lists")) & (F.call_function("bitmap_count", F.col("bits")) > 0)).select(
        "query_id", "chunk", "bits"
    )


def keep_candidates(matches: DataFrame, weighted: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The matches in documents that all long lists of their query hold.

    The intersection is broadcast if its rows, of known size, fit; else all matches stay,
    and the count of matched terms decides as always.
    """
    found = materialize(candidates(weighted, bitmaps), "candidates")
    if found.count() * BITMAP_BYTES > BROADCAST_BYTES:
        return matches
    chunk, position = (F.call_function(f, F.col("doc_id")) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    joined = matches.withColumn("chunk", chunk).join(F.broadcast(found), ["query_id", "chunk"])
    return joined.where(_has_bit(F.col("bits"), position)).drop("chunk", "bits")


@dataclass(frozen=True)
class Report:
    """Postings that the terms of the queries have, and those that were read."""

    total: int
    read: int


def range_bounds(weighted: DataFrame, blocks: DataFrame, kind: str, factor: Column) -> DataFrame:
    """``(query_id, grid, cell, bound, n)``: ranges of ``2**grid`` ids with postings of all terms of a query.

    The grid of a query is its finest one. Ranges of other terms are wider and cover whole
    cells of it, as all widths are powers of two.
    """
    keyed, keys = with_bucket(weighted, blocks)
    found = materialize(blocks.join(F.broadcast(keyed), keys).select(
        "query_id", "n_terms", "term", "shift", "block", "n", (F.col(kind) * factor).alias("most")
    ), "query-blocks")
    grids = found.groupBy("query_id").agg(F.min(F.struct("shift", "term")).alias("finest"))
    grids = grids.select("query_id", "finest.*").withColumnsRenamed({"shift": "grid", "term": "fine"})
    found = found.join(F.broadcast(grids), "query_id")
    cells = found.where(F.col("term") == F.col("fine")).select("query_id", "grid", F.col("block").alias("cell"))
    shifts = found.groupBy("query_id", "term").agg(F.first("shift").alias("shift"), F.first("n_terms").alias("n_terms"))
    wanted = cells.join(F.broadcast(shifts), "query_id")
    wanted = wanted.withColumn("block", F.call_function("shiftright", F.col("cell"), F.col("shift") - F.col("grid")))
    held = wanted.join(found.select("query_id", "term", "block", "n", "most"), ["query_id", "term", "block"])
    bounds = held.groupBy("query_id", "grid", "cell", "n_terms").agg(F.sum("most").alias("bound"), F.min("n").alias("n"), F.count(F.lit(1)).alias("held"))
    return bounds.where(F.col("held") == F.col("n_terms")).select("query_id", "grid", "cell", "bound", "n")


def first_ranges(bounds: DataFrame, limit: int) -> DataFrame:
    """The ranges with the highest bounds, until they may hold a few times ``limit`` hits."""
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    return bounds.withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0))).where(F.col("before") < 4 * limit).drop("before")


def in_ranges(postings: DataFrame, weighted: DataFrame, ranges: DataFrame) -> DataFrame:
    """Matches of the queries in the given ranges; few ranges are left to the scan to skip by."""
    some = ranges.select("grid", "cell").distinct().limit(PUSHED_RANGES + 1).collect()
    if len(some) <= PUSHED_RANGES:
        inside = F.lit(False)
        for r in some:
            inside |= F.col("doc_id").between(F.lit(r.cell << r.grid), F.lit(((r.cell + 1) << r.grid) - 1))
        postings = postings.where(inside)
    grids = ranges.groupBy("query_id").agg(F.first("grid").alias("grid"))
    keyed, keys = with_bucket(weighted.join(F.broadcast(grids), "query_id"), postings)
    matches = postings.join(F.broadcast(keyed), keys)
    matches = matches.withColumn("cell", F.call_function("shiftright", F.col("doc_id"), F.col("grid")))
    cells = ranges.select("query_id", "cell")
    return matches.join(F.broadcast(cells) if fits_broadcast(cells) else cells, ["query_id", "cell"], "left_semi")


def top_by_blocks(weighted: DataFrame, index, limit: int, kind: str, factor: Column, score, top) -> tuple[DataFrame, Report]:
    """The hits of ``top`` from two passes over ranges, and what was read.

    ``score(matches)`` makes hits of matches and ``top(hits)`` keeps the best ``limit`` of each query.
    """
    bounds = materialize(range_bounds(weighted, index.blocks, kind, factor), "bounds")
    total = weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if bounds.isEmpty():  # no range holds all terms of a query
        return top(score(in_ranges(index.postings, weighted, bounds))), Report(total, 0)
    observed = []

    def searched(ranges: DataFrame) -> DataFrame:
        seen = Observation()
        matches = in_ranges(index.postings, weighted, ranges).observe(seen, F.count(F.lit(1)).alias("rows"))
        hits = materialize(score(matches), "range-hits")
        observed.append(seen.get["rows"])
        return hits

    first = materialize(first_ranges(bounds, limit), "first-ranges")
    hits = searched(first)
    # Scores tie at nine decimals, so a bound counts as reached a little below the threshold.
    reached = top(hits).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    reached = reached.where(F.col("found") == limit).select("query_id", "least")
    rest = bounds.join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(F.broadcast(reached), "query_id", "left")
    rest = materialize(rest.where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-12) + 2e-9 >= F.col("least"))), "other-ranges")
    hits = hits.unionByName(searched(rest)) if not rest.isEmpty() else hits
    return top(hits), Report(total, sum(observed))

