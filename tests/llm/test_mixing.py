import math
from collections import defaultdict

import pytest

from tests.llm.cases import awkward, collected, documents, frame, prose, words
from wikisift.llm import mixing as M


def plain_targets(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    rest = 1.5 * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, found):
    sizes, by_source, taken = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = plain_targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((r[0] or -1, len(words(r[1]))) for r in rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        by_source[r.source].append(r.size)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(by_source[s]) / 2 + 1
        if len(by_source[s]) > 50:
            assert abs(n - target[s]) <= 0.02 * target[s]


ROWS = awkward([(1000 + i, prose(i, 5 + i % 90), "xx", ["a", "b", "c", "é", "z", None][min(i % 11, 5)]) for i in range(900)])


def test_query(spark, tmp_path):
    folder = documents(spark, tmp_path / "a", ROWS)
    found = M.op2_mixing(spark, folder)
    rows = found.collect()
    check(ROWS, rows)
    assert collected(found) == collected(M.op2_mixing(spark, folder))
    assert M.op2_mixing(spark, documents(spark, tmp_path / "b", [])).count() == 0
    no_words = [(1, None, "xx", "a"), (2, " ", "xx", None)]
    assert collected(M.op2_mixing(spark, documents(spark, tmp_path / "c", no_words)).select("doc_id", "target", "taken")) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_mixture_shards(spark):
    docs = frame(spark, ROWS)
    options = {"shards": 6, "block_docs": 4}
    drawn, plan = M.draws(docs, **options)
    mix = M.mixture(docs, **options)
    assert mix.columns[: len(docs.columns)] == docs.columns
    copies = {(r.doc_id, r.text): r[-1]["copies"] for r in drawn.collect()}
    got = defaultdict(int)
    shard_at = len(docs.columns)
    by_shard = defaultdict(lambda: defaultdict(int))
    for r in mix.collect():
        got[r.doc_id, r.text] += 1
        by_shard[r[shard_at]][r.source] += len(words(r.text))
    twice = {(2, ROWS[1][1]): 2}  # a repeated row
    assert {k: n * twice.get(k, 1) for k, n in copies.items() if n} == dict(got)
    assert sorted(by_shard) == list(range(6))
    for r in plan.collect():
        starts = r["shard_starts"]
        drawn_blocks = r["passes"] * r["blocks"] + (r["last_block"] + 1 if r["last_block"] is not None else 0)
        assert starts == sorted(starts) and len(starts) == 6 and starts[0] == 0 and starts[-1] <= drawn_blocks
    # Shares of the large source are spread by exact quotas, so no shard lacks it.
    assert all(by_shard[s]["a"] > 0 for s in range(6))


def test_splitting_tree():
    import numpy as np

    quota = np.array([50, 0, 7, 300])
    split = M._split(quota, 5, np.random.default_rng(1))
    assert (split.sum(axis=1) == quota).all() and (split >= 0).all()
    sums = split.sum(axis=0)
    assert max(sums) - min(sums) <= math.ceil(math.log2(5))
