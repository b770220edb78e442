import math
import random

import numpy as np
import pytest

from tests.llm.cases import collected
from wikisift.llm.eigen import leading_eigenpairs, sturm_counts, tridiagonalise
from wikisift.llm.whitening import fit_whitening, op13_whitening, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(seed=1, n=150, d=9):
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.normal(size=(n, d)) * np.linspace(2, 0.2, d) + 3
    return base.astype(np.float32).tolist()


def awkward():
    rows = [(i, v, 0) for i, v in enumerate(vectors())]
    rows += [(500 + i, rows[3][1], None) for i in range(40)] + [(3, rows[3][1], 0)]  # copies, and a row twice
    rows += [(600, None, 1), (601, [], 1), (602, [math.nan] + [1.0] * 8, 1), (603, [1.0] * 8 + [math.inf], 1), (604, [1.0] * 8 + [None], 1)]
    rows += [(605, [1.0, 2.0], 1), (None, [-0.0] * 9, 1)]
    random.Random(2).shuffle(rows)
    return rows


def expected(rows, size, k=4):
    usable = [(i, v) for i, v, *_ in rows if v and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    points = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in points})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array(fit, float) - np.array(sums) / n
    values, components = np.linalg.eigh(z.T @ z / n)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    out = {}
    for i, x in points:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        whitened = (np.array(x) - np.array(sums) / n) @ components / np.sqrt(values)
        for c in range(min(k, size)):
            out.setdefault((i, c + 1), []).append((n, deviation, whitened[c], values[c] / np.trace(z.T @ z / n)))
    return out


def check(found, wanted):
    assert sorted(str((r.vec_id, r.component)) for r in found) == sorted(str(key) for key, rows in wanted.items() for _ in rows)
    signs = {}
    for r in found:
        n, deviation, whitened, explained = wanted[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * whitened)) if abs(whitened) > 1e-3 else signs.get(r.component)
        if sign:
            assert r.whitened * sign == pytest.approx(whitened, rel=1e-8, abs=1e-9)


def test_whitening_as_brute_force(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(op13_whitening(spark, str(tmp_path)).collect(), expected(rows, 9))


def test_other_types_and_clashing_names(spark):
    rows = [(f"v{i}", v) for i, v in enumerate(vectors(4, 60, 5))]
    df = spark.createDataFrame(rows, "vec_id string, v array<double>").selectExpr("*", "1 AS n", "2 AS component", "'x' AS x", "3 AS d", "4 AS i")
    check(whiten(df, fit_whitening(df, "v"), "v").collect(), expected(rows, 5))


def test_little_or_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fit_whitening(empty) is None and whiten(empty, None).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0)], SCHEMA), None).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    assert collected(whiten(one, fit_whitening(one))) == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)], SCHEMA)
    found = whiten(line, fit_whitening(line)).collect()
    assert {r.component for r in found if r.whitened is not None} == {1} and {r.component for r in found} == {1, 2, 3}
    assert all(r.identity_error < 1e-12 for r in found)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e13 + i * 3.0, -1e13 + i * i, 1e13]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = whiten(df, fit_whitening(df)).where("component <= 2").collect()
    wanted = expected([(i, [v[0] - 1e13, v[1] + 1e13, 0.0]) for i, v in rows], 3)
    for r in found:
        assert r.deviation == wanted[r.vec_id, r.component][0][1]
        assert abs(r.whitened) == pytest.approx(abs(wanted[r.vec_id, r.component][0][2]), rel=1e-9, abs=1e-9)
    extreme = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id bigint, embedding array<double>")
    assert {r.deviation for r in whiten(extreme, fit_whitening(extreme)).collect()} == {None}


@pytest.mark.parametrize("kind", ["random", "tied", "identity", "split", "graded", "low rank"])
def test_eigenpairs(kind):
    rng = np.random.Generator(np.random.PCG64(5))
    size = 40
    q = np.linalg.qr(rng.normal(size=(size, size)))[0]
    spectrum = {
        "random": rng.uniform(0, 9, size), "tied": np.repeat([5.0, 5.0, 3.0, 1.0], 10), "identity": np.ones(size),
        "split": None, "graded": 10.0 ** -np.arange(size), "low rank": np.r_[4.0, 2.0, np.zeros(size - 2)],
    }[kind]
    matrix = np.diag(np.arange(size) // 3 * 1.0) if spectrum is None else (q * spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading_eigenpairs(matrix, 6)
    assert values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1][:6], abs=1e-12 * np.abs(matrix).max() * size)
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * max(1, values[0])


def test_tridiagonal_form_and_counts():
    rng = np.random.Generator(np.random.PCG64(6))
    a = rng.normal(size=(12, 12))
    a = a + a.T
    diagonal, off, _ = tridiagonalise(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    wanted = np.linalg.eigvalsh(a)
    assert np.linalg.eigvalsh(t) == pytest.approx(wanted)
    at = np.linspace(wanted[0] - 1, wanted[-1] + 1, 31)
    assert sturm_counts(diagonal, off, at).tolist() == [(wanted < x).sum() for x in at]
    for size in (0, 1, 2):
        values, vectors = leading_eigenpairs(a[:size, :size], 4)
        assert values == pytest.approx(np.linalg.eigvalsh(a[:size, :size])[::-1] if size else []) and vectors.shape == (size, size)
