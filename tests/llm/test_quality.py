import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import awkward, collected, documents, frame, prose, words
from wikisift.llm import quality as Q


def brute(text):
    text = text or ""
    w = words(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


CASES = awkward([
    (300, "a b c\n\na b c\n a b c\n\n", "xx", "a"), (301, "x y x y x y", "xx", "a"), (302, "\n", "xx", "a"), (303, "### $$$ a|b <tag> " * 20, "xx", "a"),
    (304, "\n".join(prose(i, 9) for i in range(12)) + "\n", "xx", "a"), (305, "aéb " * 60, "xx", "a"),
])


def test_counts_equal_brute_force(spark, tmp_path):
    found = Q.op8_quality(spark, documents(spark, tmp_path / "a", CASES))
    assert found.columns == ["doc_id", *Q.COUNTS, "base_failed", "kept"]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r))
    assert order(tuple(r)[:-1] for r in found.collect()) == order((r[0], *brute(r[1])) for r in CASES)
    assert not any(r.kept and r.base_failed for r in found.collect())
    assert Q.op8_quality(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_distance():
    p, q = np.array([[0.5, 0.5, 0], [0, 0, 1], [0.2, 0.3, 0.5]]), np.array([0.5, 0.5, 0])
    d = Q.js_distance(p, q)
    assert d[:2] == pytest.approx([0, 1])
    m = (p[2] + q) / 2
    want = sum(0.5 * x * np.log2(x / y) for r in (p[2], q) for x, y in zip(r, m) if x > 0)
    assert d[2] == pytest.approx(np.sqrt(want))


def test_verdict_and_references(spark):
    clean = [(i, prose(i, 200), ("xx", "yy", None)[i % 3], "a") for i in range(40)]
    noise = [(900 + i, " ".join(w + "#$%" for w in prose(i, 150).split()), "xx", "a") for i in range(3)]
    docs = frame(spark, clean + noise)
    refs = Q.build_references(frame(spark, clean))
    assert refs.languages == ["xx", "yy"] and np.allclose(refs.classes.sum(axis=1), 1) and all(np.isclose(s.sum(), 1) for s in refs.shares)
    counts = Counter("".join(r[1] for r in clean if r[2] == "xx"))
    assert refs.classes[0][0] == pytest.approx(sum(counts[c] for c in "abcdefghijklmnopqrstuvwxyz") / sum(counts.values()))
    assert {r.doc_id for r in Q.judge(docs, refs).where("kept").collect()} == {r[0] for r in clean}


def drawn(seed, n, common):
    """Words of which a share ``common`` are ten frequent ones; the rest hardly repeat."""
    rng = random.Random(seed)
    rare = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    return " ".join(rng.choice(("the of and to in is it for on as").split()) if rng.random() < common else rare() for _ in range(n))


@pytest.mark.parametrize("coverage", [0.15, 0.37, 0.7])
def test_words_can_reject_at_any_coverage(spark, coverage):
    clean = [(i, drawn(i, (60, 120, 500)[i % 3], coverage), "xx", "a") for i in range(240)]
    lists = [(900 + i, drawn(900 + i, 2000, 0), "xx", "a") for i in range(4)]
    docs = frame(spark, clean + lists)
    found = {r.doc_id: r for r in Q.judge(docs, Q.build_references(frame(spark, clean))).collect()}
    assert all(found[r[0]].class_distance < 0.3 and not found[r[0]].kept for r in lists)
    assert sum(found[r[0]].kept for r in clean) >= 0.99 * len(clean)


def test_every_label_has_a_reference(spark):
    rows = [(i, prose(i, 60), f"l{i % 70:02}", "a") for i in range(150)]
    refs = Q.build_references(frame(spark, rows))
    assert refs.languages == sorted({r[2] for r in rows}) and len(refs.columns) == len(refs.none) == 70


def test_chance_divergence():
    q = np.array([0.2, 0.1, 0.05, 0.65])
    mean, deviation = Q._chance(q)
    rng = np.random.default_rng(5)
    for at in (2, 5, 8):
        n = int(Q._LENGTHS[at])
        seen = Q.js_distance(rng.multinomial(n, q, 20_000) / n, q) ** 2
        assert mean[at] == pytest.approx(seen.mean(), rel=0.03) and deviation[at] == pytest.approx(seen.std(), rel=0.5)
        assert Q._at_length(mean[None], np.array([0]), np.array([n])) == pytest.approx(mean[at])


def test_no_references(spark):
    unlabelled = [(1, prose(1, 100), None, "a"), (2, None, None, "a")]
    found = collected(Q.judge(frame(spark, unlabelled), Q.build_references(frame(spark, unlabelled))).select("doc_id", "kept"))
    assert found == [(1, True), (2, False)]
