import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import SCHEMA, awkward, collected, documents, frame, prose
from wikisift.llm import ragged
from wikisift.llm.toxicity import FactorizationMachine, _gradient, _terms, op11_toxicity, score, train

LABELS = "doc_id bigint, quality int, toxic int"


def machine(seed=3, size=6, rank=3):
    rng = np.random.Generator(np.random.PCG64(seed))
    return FactorizationMachine(np.arange(size), 0.3, rng.normal(size=size), rng.normal(size=(size, rank)))


def plain_logit(m, terms):
    return m.bias + sum(m.weights[i] for i in terms) + sum(m.factors[i] @ m.factors[j] for i, j in combinations(terms, 2))


def test_machine_and_gradient(spark):
    m = machine()
    rows = [([0, 2, 5], 1, 2), ([], 0, 1), ([1], 1, 1), ([0, 1, 2, 3, 4, 5], 0, 3)]
    terms, owner = np.concatenate([np.array(t, int) for t, *_ in rows]), np.repeat(np.arange(4), [len(t) for t, *_ in rows])
    assert m.logits(terms, owner, 4)[0] == pytest.approx([plain_logit(m, t) for t, *_ in rows])
    found = _gradient(spark.createDataFrame(rows, "terms array<int>, label int, n bigint").repartition(3), m)

    def loss(v):
        other = FactorizationMachine(m.cells, v[0], v[1:7], v[7:].reshape(3, 6).T)
        return sum(n * np.log1p(np.exp(plain_logit(other, t) * (1 - 2 * y))) for t, y, n in rows)

    value = np.concatenate([[m.bias], m.weights, m.factors.T.reshape(-1)])
    for k in range(len(value)):
        step = np.eye(len(value))[k] * 1e-6
        assert found[k] == pytest.approx((loss(value + step) - loss(value - step)) / 2e-6, abs=1e-6)


def test_terms_are_words_and_byte_runs():
    texts = ["Stupid, stupid IDEA", "", None, "déjà-vu of a", "12 34"]
    piece = next(ragged.pieces(pa.array(texts)))
    terms, owner = _terms(piece, None)

    def plain(text):
        raw = bytes(b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
        return {w for word in raw.split() for w in [b"=" + word, *((b" " + word + b" ")[i : i + 5] for i in range(len(word) - 2))]}

    assert np.bincount(owner, minlength=5).tolist() == [len(plain(t)) for t in texts]
    some = np.sort(terms[owner == 0])[::2]
    chosen, of = _terms(piece, some)
    assert set(some[chosen[of == 0]]) == set(some) and not len(chosen[(of == 1) | (of == 2)])


def pairs(seed, n):
    """A text is toxic when an insult and a group stand in it, each alone is harmless."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        parts = prose(seed * 1000 + i, rng.randint(5, 60)).split(" ")
        for there, word in ((insult, "blockhead"), (group, "plumbers")):
            if there:
                parts.insert(rng.randrange(len(parts)), word)
        rows.append((i, " ".join(parts), int(insult and group)))
    return rows


def test_pairs_of_terms_are_learned(spark):
    def accuracy(**settings):
        docs = spark.createDataFrame([r[:2] for r in pairs(1, 500)], "doc_id bigint, text string")
        labels = spark.createDataFrame([(r[0], None, r[2]) for r in pairs(1, 500)], LABELS)
        fresh = pairs(2, 300)
        found = score(spark.createDataFrame([r[:2] for r in fresh], "doc_id bigint, text string"), train(docs, labels, **settings)).collect()
        truth = {r[0]: r[2] for r in fresh}
        return np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in found])

    assert accuracy(rounds=80) > 0.97


def test_query_on_held_out_rows(spark, tmp_path):
    rng = random.Random(5)
    rows, labels = list(awkward()), [(1, 1, 0), (2, 0, None), (None, 1, 1), (15, 1, 0), (15, 0, 0)]
    for i in range(100, 700):
        toxic = rng.random() < 0.3
        parts = prose(i, rng.randint(10, 200)).split(" ")
        if toxic:
            parts[rng.randrange(len(parts))] = "gormless" + rng.choice(["", "ly", "ness", "heit"])
        rows.append((i, " ".join(parts), None, None))
        labels.append((i, 1, int(toxic)))
    long_text = prose(7, 20_000)
    rows += [(800, long_text, "xx", None), (801, long_text + " gormlessen", "xx", None)]
    folder = documents(spark, tmp_path, rows)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    found = op11_toxicity(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    truth = {r[0]: r[2] for r in labels if r[0] and r[0] >= 100}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97 and len(held) > 80
    assert {r.doc_id: r.predicted for r in found if r.doc_id and (r.doc_id < 100 or r.doc_id >= 800)} == {**{i: 0 for i in [*range(1, 16), 800]}, 801: 1}


def test_nothing_to_learn_from(spark):
    docs, none = frame(spark), spark.createDataFrame([], LABELS)
    assert {r.score for r in score(docs, train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], LABELS)
    assert len({r.score for r in score(docs, train(docs, one)).collect()}) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert collected(score(empty, train(empty, one))) == []
