import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import awkward, collected, documents, frame, prose, words
from wikisift.llm.runs import op12_periodic_runs, periodic_runs, sequence_runs
from wikisift.llm.suffix_tree import Extensions


def plain_runs(seq, least=24, exponent=3):
    """For each period all maximal stretches of matches; a period is the smallest if no run of a smaller one holds the stretch."""
    found = []
    for q in range(1, len(seq) // exponent + 1):
        i = 0
        while i + q < len(seq):
            j = i
            while j + q < len(seq) and seq[j] == seq[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                if not any(q % p == 0 and s <= i and i + length <= s + n for s, n, p in found):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, seq):
    if doc_id is None or not seq:
        return seq
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return seq
    n, g = len(seq), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [seq[i] if i < a else seq[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    seq = planted(doc_id, words(text))
    runs = plain_runs(seq)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(seq) if i not in dropped)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repeated(seed):
    """Texts with runs of several periods that touch and overlap."""
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(1, 5)):
        kind, period = rng.random(), rng.choice([1, 2, 3, 5, 8, 13])
        root = [rng.choice("ab" if kind < 0.5 else "abcde") for _ in range(period)]
        parts += (root * 40)[: rng.randint(1, 90)] if kind < 0.8 else [rng.choice("abc") for _ in range(rng.randint(1, 40))]
    return " ".join(parts)


def test_query_as_brute_force(spark, tmp_path):
    chosen = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [r for r in awkward() if r[0] not in (9, 10)] + [(i, prose(i, 40 + i), "xx", "a") for i in chosen]
    rows += [(1000 + i, repeated(i), "xx", "a") for i in range(60)] + [(2000, "x " * 3000 + "y " * 23, None, None), (2001, "café\t" * 30, None, "b")]
    rows += [(i, v, None, None) for i, v in zip(chosen[:3], (None, "", "one"))]
    found = collected(op12_periodic_runs(spark, documents(spark, tmp_path, rows)))
    wanted = sorted((expected(r[0], r[1]) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])
    assert found == wanted
    assert sum(r[1] > 0 for r in found) > 50


def test_operator_on_awkward_rows(spark):
    found = {(r.doc_id, r.n_words, r.collapsed, tuple(map(tuple, r.runs))) for r in periodic_runs(frame(spark)).collect()}
    assert found == {(i, len(words(t)), " ".join(words(t)), ()) for i, t, *_ in awkward() if i not in (11, 12)} | {
        (11, 150, "né à l'été 東京 \U0001f600", ((0, 150, 5),)),
        (12, 40, "dup line here with quite a few words in it", ((0, 40, 10),)),
    }
    assert periodic_runs(frame(spark, [])).count() == 0


def test_long_text_of_one_run(spark):
    rows = [(1, " ".join(map(str, list(range(20_000)) * 3)) + " end", None, None), (2, "w " * 50_000, None, None)]
    found = {r.doc_id: (r.n_words, tuple(map(tuple, r.runs)), len(words(r.collapsed))) for r in periodic_runs(frame(spark, rows, clashing=False)).collect()}
    assert found == {1: (60_001, ((0, 60_000, 20_000),), 20_001), 2: (50_000, ((0, 50_000, 1),), 1)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.sampled_from([(2, 2), (4, 2), (6, 3), (24, 3), (5, 4)]))
def test_runs_of_short_sequences(seq, limits):
    assert [tuple(r) for r in sequence_runs(np.array(seq, np.uint64), *limits)] == plain_runs(seq, *limits)


@pytest.mark.parametrize("kind", ["fibonacci", "random", "one", "blocks"])
def test_extensions(kind):
    rng = random.Random(4)
    a, b = [1], [1, 2]
    while len(b) < 300:
        a, b = b, b + a
    seq = {"fibonacci": b, "random": [rng.randint(1, 3) for _ in range(500)], "one": [1] * 200, "blocks": [1, 2, 3] * 60 + [2] + [1, 2, 3] * 60}[kind]
    tree = Extensions(seq)
    assert tree.order.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])
    pairs = [(i, j) for i, j in ((rng.randrange(len(seq)), rng.randrange(len(seq))) for _ in range(2000)) if i != j]
    common = tree.common(*map(np.array, zip(*pairs)))
    for (i, j), n in zip(pairs, common.tolist()):
        assert seq[i : i + n] == seq[j : j + n] and (max(i, j) + n == len(seq) or seq[i + n] != seq[j + n])
