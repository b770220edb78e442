import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import awkward, collected, documents, edited, frame, lower, prose, words
from wikisift.llm import graph, ngram_join, ragged
from wikisift.llm.graph import components, forest
from wikisift.llm.ngram_join import near_duplicates, op4_ngram_join


def brute(rows, percent=75):
    sets = []
    for r in rows:
        w = words(lower(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if None not in (a[0], b[0]) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = root(a[0]), root(b[0])
                parent[max(x, y)] = min(x, y)
    out = [(r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets)]
    return sorted(out, key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def corpus():
    """Chains of near copies, short texts, a common line, and a large group."""
    rows = awkward()
    base = prose(50, 90)
    parts = base.split(" ")
    for i in range(12):  # each links with its neighbours only
        rows.append((100 + i, " ".join(parts[i * 2 : i * 2 + 60]), "xx", "a"))
    line = " ".join(prose(51, 14).split())
    for i in range(40):
        rows.append((200 + i, f"{prose(400 + i, 5 + i % 9)} {line}", "xx", "a"))
    for i in range(30):
        rows.append((300 + i, edited(base, [(i * 7) % 80, (i * 11) % 80]), "yy", "b"))
    rows += [(400, "a b c", "xx", "a"), (401, "A B C", "xx", "a"), (402, "a b c d", "xx", "a"), (403, "a b c d e", "xx", "a")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert collected(near_duplicates(frame(spark, rows))) == brute(rows)


def passages(seed):
    """Many texts of passages they share, with little of their own, some above the threshold and some below."""
    rng = random.Random(seed)
    shared = [prose(900 + i, 24) for i in range(7)]
    return [(i, " ".join([*rng.sample(shared, 5), *prose(2000 + i, rng.choice([0, 1, 6, 20])).split()]), "xx", "a") for i in range(160)]


@pytest.mark.parametrize("most", [4096, 9])
def test_large_blocks_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "_BLOCK_ROWS", most)
    rows = passages(most)
    assert collected(near_duplicates(frame(spark, rows))) == brute(rows)


def test_group_of_near_copies(spark):
    base = prose(60, 120)
    rows = [(i, edited(base, [i % 97, (i * 7) % 89, (i * 13) % 101]), "xx", "a") for i in range(500)] + [(500 + i, prose(700 + i, 100), "xx", "a") for i in range(20)]
    assert collected(near_duplicates(frame(spark, rows))) == brute(rows)


def test_forest(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(5000)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(4)
    kept = forest(df)
    assert kept.count() <= 4 * 301
    assert collected(components(kept)) == collected(components(df.where("u IS NOT NULL")))


def test_query_and_empty_table(spark, tmp_path):
    rows = awkward()
    assert collected(op4_ngram_join(spark, documents(spark, tmp_path / "a", rows))) == brute(rows)
    assert op4_ngram_join(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_components(spark):
    links = [(9, 4), (4, 7), (1, 2), (2, 3), (3, 1), (5, 5)] + [(i, i + 1) for i in range(100, 160)] + [(50, x) for x in range(20, 40)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect())
    want = {9: 4, 7: 4, 4: 4, 1: 1, 2: 1, 3: 1, 50: 20} | {i: 100 for i in range(100, 161)} | {x: 20 for x in range(20, 40)}
    assert found == want


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_few_links_need_few_tables(spark, monkeypatch, kind):
    """Every round writes several tables; a long chain took over 20 however few its links were."""
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 8)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "u bigint, v bigint").selectExpr(f"cast(u as {kind}) u", f"cast(v as {kind}) v")
    written = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda *a: written.append(a[1]) or write(*a))
    few = collected(components(df))
    tables = len(written)
    monkeypatch.setattr(graph, "_FEW_LINKS", 50)  # rounds first, one task for what remains
    assert collected(components(df)) == few and len(written) > 2 * tables
    monkeypatch.setattr(graph, "_FEW_LINKS", 0)
    assert collected(components(df)) == few
    assert tables <= 4


def test_sets_of_a_piece_take_little_memory():
    """The hashes of a piece once had several numbers for every byte, and as many powers stayed in the worker."""
    rng = np.random.default_rng(9)
    letters = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    letters[rng.integers(0, len(letters), len(letters) // 6)] = 0x20
    piece = next(ragged.pieces(pa.array([part.tobytes() for part in np.array_split(letters, 100)], pa.binary())))
    ragged._powers.clear()
    tracemalloc.start()
    try:
        grams, owner, sizes, sids = ngram_join._sets(piece, 5)
        most = tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()
    assert len(grams) == sizes.sum() > 100_000 and len(sids) == 100
    starts, ends, before = ragged.words(piece.data, piece.offsets)
    plain = ragged.ngrams(ragged.Hasher(piece.data).spans(starts, ends), before, 5)[0]
    assert sorted(np.unique(plain)) == sorted(np.unique(grams))
    assert most < 25
