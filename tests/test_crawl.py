import random
from collections import deque

import pytest

from wikisift.operators import links as graph
from wikisift.operators.links import crawl_order

LINKS = "from_page string, to_page string, position int"
SEEDS = "page_name string, position int"


def queue(links, seeds):
    """A plain queue: pages are taken from the front, links of unknown pages go to the end."""
    by_page = {}
    for f, t, p in sorted(links, key=lambda x: x[2]):
        by_page.setdefault(f, []).append((t, p))
    order, waiting = {}, deque()
    for name, _ in sorted(seeds, key=lambda s: (s[1], s[0])):
        if name not in order:
            order[name] = (name, 0, None, None, len(order))
            waiting.append(name)
    while waiting:
        page = waiting.popleft()
        for target, position in by_page.get(page, []):
            if target is not None and target not in order:
                order[target] = (target, order[page][1] + 1, page, position, len(order))
                waiting.append(target)
    return sorted(order.values(), key=lambda r: r[4])


def crawled(spark, links, seeds, **options):
    found = crawl_order(spark.createDataFrame(links, LINKS), spark.createDataFrame(seeds, SEEDS), **options)
    return [tuple(r) for r in found.orderBy("visit_order").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_a_queue_visits(spark, seed):
    rng = random.Random(seed)
    links = [(f"p{rng.randrange(60)}", f"p{rng.randrange(60)}", i) for i in range(130)] + [("p1", None, 500), ("p0", "p0", 501), (None, "p3", 502)]
    links += [(f"p{i}", "hub", 900 + i) for i in range(60)]
    seeds = [("p7", 2), ("p3", 1), ("p7", 0), (None, 5)]
    assert crawled(spark, links, seeds, buckets=3) == queue(links, [s for s in seeds if s[0]][1:])


def test_depth_limit_and_nothing(spark):
    chain = [(f"c{i}", f"c{i + 1}", 0) for i in range(5)]
    assert [r[0] for r in crawled(spark, chain, [("c0", 0)], max_depth=2)] == ["c0", "c1", "c2"]
    assert crawled(spark, [], [("x", 0)]) == [("x", 0, None, None, 0)]
    assert crawled(spark, chain, []) == []


@pytest.mark.parametrize(("block_links", "burst_links"), [(1, 12), (7, 40), (20, 10), (1000, 100_000)])
def test_bursts_and_rounds_in_turn(spark, block_links, burst_links):
    rng = random.Random(block_links)
    links = [(f"p{i:03}", f"p{min(i + rng.randrange(1, 4), 79):03}", rng.randrange(5)) for i in range(80) for _ in range(2)]
    links += [(f"p{rng.randrange(80):03}", f"p{rng.randrange(80):03}", None) for _ in range(6)] + [("p010", f"leaf{i}", 9) for i in range(5)]
    # A page has a link at a place once.
    links = list({(f, p, t): (f, t, p) for f, t, p in links if p is not None}.values())
    links.sort(key=lambda x: (x[0], x[2], x[1]))
    seeds = [("p000", 0), ("p040", 1), ("leaf3", 2)]
    assert crawled(spark, links, seeds, block_links=block_links, burst_links=burst_links) == queue(links, seeds)


def test_a_narrow_crawl_takes_no_job_for_each_level(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}", 0) for i in range(150)] + [("c020", "c090", 1)]
    group = "narrow-crawl"
    spark.sparkContext.setJobGroup(group, group)
    found = crawled(spark, chain, [("c000", 0)], block_links=10, burst_links=60)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert found == queue(chain, [("c000", 0)])
    assert jobs < 300


def test_far_links_do_not_end_a_task_that_has_room(spark, monkeypatch):
    """Links from every page to far ones: what a task still takes are all other blocks, not only the nearest."""
    rng = random.Random(4)
    links = [(f"c{i:03}", f"c{i + 1:03}", 5) for i in range(300)]
    links += [(f"c{i:03}", f"d{j}{rng.randrange(40):03}", rng.randrange(5)) for i in range(0, 300, 7) for j in range(3)]
    links += [(f"d{j}{i:03}", f"e{i}", None) for i in range(40) for j in range(3)] + [(f"e{i}", f"d{i % 3}{i:03}", 1) for i in range(40)]
    links = list({(f, p): (f, t, p) for f, t, p in links}.values())
    tasks = []
    monkeypatch.setattr(graph, "_follow", lambda *a, make=graph._follow: tasks.append(a[0]) or make(*a))
    by_place = [(f, t, -1 if p is None else p) for f, t, p in links]
    expected = [(n, d, f, None if p == -1 else p, v) for n, d, f, p, v in queue(by_place, [("c000", 0)])]
    assert crawled(spark, links, [("c000", 0)], block_links=4, burst_links=len(links)) == expected
    assert len(tasks) == 1


def test_a_task_gets_links_as_numbers_in_batches():
    import pyarrow as pa

    names = ("is_link", "from_id", "position", "to_id", "to_block")
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    rows = [(0, 4, None, None, None), (0, 7, 1, None, 0), (0, 9, 0, None, 0)]
    # Page 7 leads to 3 twice, and to the known 4; page 9 to 2 and 3 from one place; page 2 to 20, whose links are elsewhere.
    rows += [(1, 2, 0, 20, 6), (1, 7, None, 3, None), (1, 7, 0, 4, 0), (1, 7, 2, 3, None), (1, 9, 5, 2, 0), (1, 9, 5, 3, None)]
    for size in (1, 4, 100):
        parts = [rows[i:i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names) for part in parts]
        found = pa.Table.from_batches(list(graph._follow({0}, 10, 50, None)(iter(batches)))).to_pylist()
        assert [tuple(r.values()) for r in found] == [(2, 11, 9, 5, 50, 0), (3, 11, 9, 5, 51, None), (20, 12, 2, 0, 52, 6)]
