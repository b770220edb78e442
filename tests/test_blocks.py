import random
from collections import Counter
from dataclasses import replace

import pytest

from wikisift.operators import blocks
from wikisift.operators import search as search_module
from wikisift.operators.postings import TextIndex
from wikisift.operators.search import query_table, search, search_best

QUERIES = ["a b", "a b c", "b", "c a", "rare a", "missing a", "d c b a", "e e"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    share = {"a": 0.95, "b": 0.8, "c": 0.5, "d": 0.3, "e": 0.2}
    docs = []
    for i in range(3000):
        words = [w for w, p in share.items() if rng.random() < p for _ in range(rng.choice([1, 1, 1, 2, 2, 9 if 1000 <= i < 1060 else 1]))]
        docs.append((i, " ".join(words + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))] + ["rare"] * (i in (7, 2222)))))
    docs += [(40_000 + i, "a b c") for i in range(30)]  # another bitmap chunk
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return TextIndex.build(df).save(str(tmp_path_factory.mktemp("blocks")), buckets=4, blocks=True, bitmap_least=200, block_rows=16)


def rows(hits, *columns):
    return sorted((r.query_id, r.doc_id, round(r.score, 9), *(r[c] for c in columns)) for r in hits.collect())


MODES = [{}, {"tf": "log"}, {"tf": "max"}, {"normalize": "euc"}, {"tf": "log", "normalize": "euc"}, {"tf": "max", "normalize": "euc"}, {"similarity": "cos"}]


@pytest.mark.parametrize("mode", MODES[::3])
def test_bitmaps_leave_the_hits_as_they_are(spark, index, mode):
    queries = query_table(spark, QUERIES)
    pruned = search(queries, index, **mode, rank=False, prune_rows=1)
    assert "bitmap_bucket_number" in pruned._jdf.queryExecution().optimizedPlan().toString() or "chunk" in pruned._jdf.queryExecution().optimizedPlan().toString()
    assert rows(pruned) == rows(search(queries, index, **mode, rank=False))


def test_bitmap_rows(index):
    found = {(r.term, r.chunk) for r in index.bitmaps.collect()}
    assert {("a", 1), ("a", 2), ("e", 1)} <= found and ("rare", 1) not in found and ("e", 2) not in found


@pytest.mark.parametrize("mode", MODES)
def test_block_maxima_find_the_best_hits(spark, index, mode):
    queries = query_table(spark, QUERIES)
    hits, report = search_best(queries, index, 5, **mode)
    assert rows(hits, "rank") == rows(search(queries, index, limit=5, **mode), "rank")
    assert 0 < report.read <= 2 * report.total


def test_fewer_postings_are_read(spark, index):
    _, report = search_best(query_table(spark, ["a b"]), index, 2, tf="log")
    assert report.read < report.total / 3


def test_no_hits(spark, index):
    hits, report = search_best(query_table(spark, ["missing", "rare missing"]), index, 5)
    assert hits.count() == 0 and report.total == report.read == 0


def test_a_large_vocabulary_is_neither_copied_nor_broadcast(index, monkeypatch):
    whole = blocks.blocks_of(index.postings, index.terms, 16)
    monkeypatch.setattr(blocks, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(blocks, "ROWS_PER_SPLIT", 1000)
    cut = blocks.blocks_of(index.postings, index.terms, 16)
    assert "BroadcastHashJoin" not in cut._jdf.queryExecution().executedPlan().toString()
    assert Counter(cut.select(*whole.columns).collect()) == Counter(whole.collect())


@pytest.mark.parametrize("mode", MODES[::3])
@pytest.mark.parametrize("most", [1, 1500])
def test_long_rarest_lists_still_cut_the_others(spark, index, mode, most, monkeypatch):
    """Without bitmaps; the candidates are broadcast or meet the vectors, never all postings the shuffle."""
    monkeypatch.setattr(search_module, "RARE_TERMS", 2)
    plain = replace(index, bitmaps=None)
    queries = query_table(spark, ["a b c d w1 w2", "d a c b w3 w4", "w1", "a missing"])
    pruned = search(queries, plain, **mode, rank=False, prune_rows=most)
    assert "candidates" in pruned._jdf.queryExecution().executedPlan().toString()
    assert rows(pruned) == rows(search(queries, plain, **mode, rank=False))
