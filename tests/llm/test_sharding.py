import zlib

from tests.llm.cases import awkward, documents, frame, prose
from wikisift.llm.sharding import op9_sharding, shard_by_bytes


def check(rows, found, shards):
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    ordered = sorted(rows, key=key)
    sizes = [len((r[1] or "").encode()) + 8 for r in ordered]
    total, before, slots, want = sum(sizes), 0, {}, []
    for r, size in zip(ordered, sizes):
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        want.append((r[0], size, zlib.crc32((r[1] or "").encode()), "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    assert sorted(map(tuple, found), key=lambda r: (r[4], r[5])) == want


def test_equals_plain_prefix_sums(spark, tmp_path):
    rows = awkward([(1000 + i, prose(i, i % 60), "xx", "a") for i in range(300)])
    check(rows, shard_by_bytes(frame(spark, rows), 7).collect(), 7)
    check(rows, op9_sharding(spark, documents(spark, tmp_path / "a", rows)).collect(), 24)
    assert op9_sharding(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_shards_are_balanced(spark):
    rows = [(i, prose(i, 20 + i % 30), "xx", "a") for i in range(2000)]
    sizes = shard_by_bytes(frame(spark, rows), 24).groupBy("shard").sum("size").collect()
    assert len(sizes) == 24 and max(r[1] for r in sizes) - min(r[1] for r in sizes) < 1000


def test_plan_has_no_python(spark):
    plan = shard_by_bytes(frame(spark, awkward()), 24)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
