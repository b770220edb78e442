"""Link graph and crawl frontier of a page collection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.functions.urls import hrefs, is_content_url, page_name, resolve_link
from wikisift.operators.postings import unseen
from wikisift.operators.ranking import assign_ids, with_positions
from wikisift.operators.skew import fits_broadcast
from wikisift.sources.tables import MANY_BUCKETS, choose_buckets, materialize, scratch_dir, term_bucket

if TYPE_CHECKING:
    import pyarrow as pa


def raw_links(pages: DataFrame) -> DataFrame:
    """``(url, href, position)``: every href of a page in order."""
    return pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("position", "href"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """``(url, to_url, position)`` with absolute targets, also those outside the site.

    Resolved before the explode, so that the conditions on a target read a column and
    do not each resolve it again.
    """
    targets = F.transform(hrefs(F.col("html")), lambda href: resolve_link(F.col("url"), href))
    return pages.select("url", F.posexplode(targets).alias("position", "to_url")).select(
        "url", "to_url", "position"
    )


def extract_links(pages: DataFrame, prefix: str) -> DataFrame:
    """``(from_page, to_page, position)`` of all links to content pages of the site."""
    inside = resolved_links(pages).where(is_content_url(F.col("to_url"), prefix))
    return inside.select(
        page_name(F.col("url"), prefix).alias("from_page"),
        page_name(F.col("to_url"), prefix).alias("to_page"),
        "position",
    )


def frontier(links: DataFrame, known_pages: DataFrame) -> DataFrame:
    """``(page_name, from_page, position)``: pages still to fetch and where each is first seen.

    Links are reduced to one row per target before the anti-join, with partial
    minima on the map side, so a page that everything links to causes no skew.
    """
    first_seen = links.groupBy(F.col("to_page").alias("page_name")).agg(
        F.min(F.struct("from_page", "position")).alias("first")
    )
    return unseen(first_seen, known_pages, "page_name").select(
        "page_name", "first.from_page", "first.position"
    )


VISITED = "id bigint, depth int, from_id bigint, position bigint, visit_order bigint, block int"
# Links of neighbouring pages that are stored together, links that a task follows at a time, and neighbours of a block that are kept.
BLOCK_LINKS = 5_000
BURST_LINKS = 8_000_000
NEAR_BLOCKS = 8


def _pages(links: DataFrame, seeds: DataFrame, block_links: int) -> DataFrame:
    """``(page_name, id, block)``: pages numbered by name; ``block`` for those with links that lead somewhere.

    Blocks are cut from the order of ``place``, or else of names, where a block has its links.
    """
    order = [F.col(c) for c in ("place", "from_page") if c in links.columns]
    numbered = with_positions(links.where(F.col("from_page").isNotNull() & F.col("to_page").isNotNull()), order, "_n")
    first = F.floor(F.min("_n") / F.lit(block_links)).cast("int")
    blocks = numbered.groupBy(F.col("from_page").alias("page_name")).agg(first.alias("block"))
    names = links.select("from_page").union(links.select("to_page")).union(seeds.select("page_name")).toDF("page_name")
    ids = assign_ids(names.where(F.col("page_name").isNotNull()).distinct(), "page_name", "id")
    return materialize(ids.join(blocks, "page_name", "left").select("page_name", "id", "block"), "crawl-pages")


Blocks = dict[int, tuple[int, list[tuple[int, int]]]]


def _block_graph(links: DataFrame) -> Blocks:
    """The links of each block, and the few other blocks that most of them lead to, each with its number of links."""
    counts = links.groupBy("block", "to_block").agg(F.count(F.lit(1)).alias("n"))
    others = F.when(F.col("to_block") != F.col("block"), F.struct("n", "to_block"))
    near = F.slice(F.sort_array(F.collect_list(others), asc=False), 1, NEAR_BLOCKS)
    rows = counts.groupBy("block").agg(F.sum("n").alias("n"), near.alias("near")).collect()
    return {r.block: (r.n, [(n, b) for n, b in r.near]) for r in rows}


def _burst_blocks(graph: Blocks, needed: list[int], burst_links: int) -> set[int] | None:
    """The blocks ``needed`` and as many others as a burst takes; None if it does not take the first ones.

    Those to which most links lead come first, then the ones that follow in the order of blocks.
    """
    chosen = set(needed)
    room = burst_links - sum(graph[b][0] for b in chosen)
    if room < 0:
        return None
    waiting = [(-n, b) for first in needed for n, b in graph[first][1]]
    heapify(waiting)
    while waiting:
        _, b = heappop(waiting)
        if b not in chosen and b in graph and graph[b][0] <= room:
            room -= graph[b][0]
            chosen.add(b)
            for n, other in graph[b][1]:
                heappush(waiting, (-n, other))
    start = min(needed, default=0)
    for b in sorted(graph, key=lambda b: (b < start, b)):
        if b not in chosen and graph[b][0] <= room:
            room -= graph[b][0]
            chosen.add(b)
    return chosen


def _follow(loaded: set[int], depth: int, count: int, max_depth: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that follows links level by level until a page has links that are not ``loaded``.

    It gets ``(is_link, from_id, position, to_id, to_block)`` in that order: first the level, whose
    ``position`` is its visit order, and the other visited pages, which have none; then the links. They stay
    arrays of numbers, about 110 bytes a link at the peak.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        columns: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for column, name in zip(columns, ("is_link", "from_id", "to_id", "to_block", "position")):
                column.append(batch.column(name).fill_null(-1).to_numpy())
            columns[5].append(batch.column("position").is_valid().to_numpy(zero_copy_only=False))
        is_link, pages, target, block, position, valid = (np.concatenate(c) for c in columns)
        del columns
        n = len(is_link) - int(is_link.sum())
        nodes = np.unique(np.concatenate((pages, target[n:])))
        known, level = (np.searchsorted(nodes, p) for p in (pages[:n], pages[:n][valid[:n]][np.argsort(position[:n][valid[:n]])]))
        counts = np.bincount(np.searchsorted(nodes, pages[n:]), minlength=len(nodes))
        starts = np.cumsum(counts) - counts
        target = np.searchsorted(nodes, target[n:])
        blocks = np.full(len(nodes), -1, block.dtype)
        blocks[target] = block[n:]
        blocks[known[valid[:n]]] = block[:n][valid[:n]]
        elsewhere = (blocks >= 0) & ~np.isin(blocks, sorted(loaded))
        seen = np.zeros(len(nodes), bool)
        seen[known] = True
        at, found = depth, []
        while len(level) and (max_depth is None or at < max_depth) and not elsewhere[level].any():
            at += 1
            sizes = counts[level]
            ends = np.cumsum(sizes)
            link = np.arange(ends[-1]) + np.repeat(starts[level] - ends + sizes, sizes)
            new = ~seen[target[link]]
            link, parent = link[new], np.repeat(level, sizes)[new]
            # A page is found by the first of its links.
            firsts = np.sort(np.unique(target[link], return_index=True)[1])
            link, parent = link[firsts], parent[firsts]
            level = target[link]
            seen[level] = True
            found.append((link, parent, np.full(len(link), at)))
        if not found:
            return
        link, parent, depths = (np.concatenate(c) for c in zip(*found))
        to = target[link]
        fields = (
            ("id", nodes[to], None), ("depth", depths, None), ("from_id", nodes[parent], None), ("position", position[n:][link], ~valid[n:][link]),
            ("visit_order", count + np.arange(len(link)), None), ("block", blocks[to], blocks[to] < 0),
        )
        types = {"depth": pa.int32(), "block": pa.int32()}
        arrays = [pa.array(values, types.get(name, pa.int64()), mask=mask) for name, values, mask in fields]
        yield from pa.table(arrays, [name for name, _, _ in fields]).to_batches(100_000)

    return run


def crawl_order(
    links: DataFrame, seeds: DataFrame, buckets: int | None = None, max_depth: int | None = None,
    block_links: int = BLOCK_LINKS, burst_links: int = BURST_LINKS,
) -> DataFrame:
    """The pages in the order in which a queue visits them, from ``seeds(page_name, position)`` on.

    ``(page_name, depth, from_page, position, visit_order)``: a page is queued when it is first
    seen, by ``from_page`` at ``position`` in it; seeds have no ``from_page``. ``links`` are
    ``(from_page, to_page, position)``; a column ``place`` says which pages stand near each
    other, else their names do. Results do not depend on it.

    A level needs the order of the one before, so levels follow one another. Pages are numbered
    by name, and names come back at the end. Links are stored in blocks of near pages. While the
    blocks of a level have no more than ``burst_links`` links, one task gets them and those they
    lead to, sorted and batch by batch, and follows levels until a page has links elsewhere; a
    narrow crawl thus takes steps by blocks, not by levels. A wider
    level is a distributed round, which reads the blocks of its own pages and, stored by a hash
    bucket, the visited pages among its targets. Each step is a written table, so a lost
    executor costs a re-read.
    """
    spark = links.sparkSession
    folder = f"{scratch_dir(spark)}/crawl-{uuid.uuid4().hex}"
    place = [c for c in ("place",) if c in links.columns]
    stored = materialize(links.select("from_page", "to_page", F.col("position").cast("bigint").alias("position"), *place), "crawl-links")
    total = stored.count()
    buckets = buckets or choose_buckets(total)
    first = materialize(seeds.groupBy("page_name").agg(F.min("position").alias("seed")).where(F.col("page_name").isNotNull()), "crawl-seeds")
    pages = _pages(stored, first, max(block_links, -(-total // MANY_BUCKETS)))
    sources = pages.select(F.col("page_name").alias("from_page"), F.col("id").alias("from_id"), "block")
    targets = pages.select(F.col("page_name").alias("to_page"), F.col("id").alias("to_id"), F.col("block").alias("to_block"))
    by_page = stored.drop("place").join(sources, "from_page").join(targets, "to_page")
    by_page = by_page.select("from_id", "to_id", "position", "to_block", "block")
    by_page.repartitionByRange("block", "from_id").sortWithinPartitions("block", "from_id").write.partitionBy("block").parquet(f"{folder}/links")
    by_page = spark.read.schema(by_page.schema).parquet(f"{folder}/links")
    graph = _block_graph(by_page)

    def visited() -> DataFrame:
        return spark.read.schema(f"{VISITED}, step int, bucket int").parquet(f"{folder}/visited")

    def store(found: DataFrame, step: int) -> DataFrame:
        placed = found.withColumn("bucket", term_bucket(F.col("id"), buckets))
        placed.write.partitionBy("bucket").parquet(f"{folder}/visited/step={step}")
        return spark.read.schema(f"{VISITED}, bucket int").parquet(f"{folder}/visited/step={step}")

    def looked_up(table: DataFrame, small: DataFrame, keys: list[str], partition: str) -> DataFrame:
        # The condition always holds; Spark prunes partitions only by a side that has one.
        small = small.where(f"{partition} >= 0")
        return table.join(F.broadcast(small) if fits_broadcast(small) else small, keys)

    def burst(level: DataFrame, loaded: set[int]) -> DataFrame:
        near = by_page.where(F.col("block").isin(sorted(loaded)))
        ends = near.select(F.col("to_id").alias("id")).distinct().withColumn("bucket", term_bucket(F.col("id"), buckets))
        known = looked_up(visited().select("id", "bucket"), ends, ["bucket", "id"], "bucket")
        none = "CAST(NULL AS BIGINT)"
        rows = level.selectExpr("0 AS is_link", "id AS from_id", "visit_order AS position", f"{none} AS to_id", "block AS to_block")
        rows = rows.unionAll(known.selectExpr("0", "id", none, none, "CAST(NULL AS INT)"))
        rows = rows.unionAll(near.selectExpr("1", "from_id", "position", "to_id", "to_block"))
        placed = rows.repartition(1).sortWithinPartitions("is_link", "from_id", "position", "to_id")
        return placed.mapInArrow(_follow(loaded, depth, count, max_depth), VISITED)

    def round(level: DataFrame) -> DataFrame:
        parents = level.select(F.col("id").alias("from_id"), "visit_order", "block")
        found = looked_up(by_page, parents, ["block", "from_id"], "block")
        found = found.groupBy(F.col("to_id").alias("id")).agg(F.min(F.struct("visit_order", "position", "from_id", "to_block")).alias("seen"))
        found = materialize(found.withColumn("bucket", term_bucket(F.col("id"), buckets)), "targets")
        known = looked_up(visited().select("id", "bucket"), found.select("id", "bucket"), ["bucket", "id"], "bucket")
        new = found.join(known.select("id"), "id", "left_anti")
        new = new.select("id", F.lit(depth + 1).alias("depth"), "seen.from_id", "seen.position", F.col("seen.visit_order").alias("parent"), F.col("seen.to_block").alias("block"))
        new = with_positions(materialize(new, "new-targets"), [F.col("parent"), F.col("position"), F.col("id")], "visit_order")
        return new.withColumn("visit_order", F.col("visit_order") + count).select("id", "depth", "from_id", "position", "visit_order", "block")

    first = with_positions(first, [F.col("seed"), F.col("page_name")], "visit_order").join(pages, "page_name")
    level = store(first.selectExpr("id", "0 AS depth", "CAST(NULL AS BIGINT) AS from_id", "CAST(NULL AS BIGINT) AS position", "visit_order", "block"), 0)
    step, depth, count = 0, 0, level.count()
    width = count
    while width and (max_depth is None or depth < max_depth):
        step += 1
        needed = [r.block for r in level.select("block").distinct().where(F.col("block").isNotNull()).collect()]
        loaded = _burst_blocks(graph, needed, burst_links) if width <= burst_links else None
        found = store(round(level) if loaded is None else burst(level, loaded), step)
        ends = found.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("depth", "n")).alias("last"), F.sum("n").alias("n")).first()
        # A task with all blocks goes on to the end.
        if ends.last is None or loaded == set(graph):
            break
        (depth, width), count = ends.last, count + ends.n
        level = found.where(F.col("depth") == depth)
    named = visited().join(pages.select("id", "page_name"), "id").join(sources.select("from_id", "from_page"), "from_id", "left")
    return named.select("page_name", "depth", "from_page", "position", "visit_order")
