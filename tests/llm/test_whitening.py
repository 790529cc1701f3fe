"""Whitening against numpy's eigenvectors and exact sums."""

import random
from fractions import Fraction

import numpy as np
import pytest

from loadgrid.llm import registry, whitening
from tests.oracle import DATA

SCHEMA = "vec_id long, embedding array<float>, x string, n long, component string, __id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "c", 2) for i, v in rows], SCHEMA)


def plain(rows):
    """(x of each valid row, fit list) as whole numbers."""
    valid = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return valid, sorted({tuple(x) for _, x in valid})


def check(got, rows, count=4):
    valid, fit = plain(rows)
    n, size = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(size)]
    m = np.array([[float(x[k] - Fraction(sums[k], n)) for k in range(size)] for x in fit])
    v = m.T @ m / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    shown = min(count, size)
    assert sorted(by) == list(range(1, shown + 1))
    for k, own in by.items():
        assert sorted(r.vec_id for r in own) == sorted(i for i, _ in valid)
        want = {}
        for i, x in valid:
            want.setdefault(i, []).append((np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums)]) @ u[:, k - 1] / np.sqrt(e[k - 1]), sum((n * c - s) ** 2 for c, s in zip(x, sums))))
        signs = set()
        for r in own:
            w, d = want[r.vec_id][0]
            assert r.n == n and r.deviation == d and abs(abs(r.whitened) - abs(w)) < 1e-7 * max(1, abs(w))
            assert r.explained == pytest.approx(e[k - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-8
            if abs(w) > 1e-6:
                signs.add(r.whitened * w > 0)
        assert len(signs) == 1


def test_query_is_whitening_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(registry.QUERIES["op11_embedding_whitening"](spark, DATA).collect(), rows)


def test_repeats_nulls_and_odd_rows(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1 + k) for k in range(6)] for _ in range(60)]
    rows = [(k, v) for k, v in enumerate(base)] + [(100 + k, base[0]) for k in range(200)] + [(5, base[5])]
    odd = [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] * 6), (904, [1.0] * 5 + [float("inf")]), (905, [-float("inf")] + [1.0] * 5)]
    got = whitening.whitened(frame(spark, rows + odd).repartition(7))
    assert not {r.vec_id for r in got.collect()} & {i for i, _ in odd}
    check(got.collect(), rows)
    assert whitening.whitened(frame(spark, [])).count() == 0 and whitening.whitened(frame(spark, odd)).count() == 0
    null_id = whitening.whitened(frame(spark, [*rows, (None, base[1])])).where("vec_id IS NULL").collect()
    assert len(null_id) == 4


def test_too_few_dimensions_and_no_spread(spark):
    got = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert len(got) == 6
    first = [r for r in got if r.component == 1]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 and r.n == 2 for r in first)
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component == 2)
    alone = whitening.whitened(frame(spark, [(1, [1.0, 2.0, 3.0])])).collect()
    assert len(alone) == 3 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in alone)
    mixed = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [1.0])]))
    assert {r.vec_id for r in mixed.collect()} == {1, 2}


def test_large_numbers_stay_exact(spark):
    rng = random.Random(9)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1) * 10**s)) for s in (0, 6, 12)]) for k in range(50)]
    valid, fit = plain(rows)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    got = whitening.whitened(frame(spark, rows)).where("component = 1").collect()
    want = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in valid}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in want.items()}


@pytest.mark.parametrize("spectrum", [[9, 5, 3, 1, 0.5], [4, 4, 4, 1, 1], [1, 1, 1, 1, 1], [5, 1e-3, 1e-3, 1e-9, 0], [1 + 1e-9, 1, 0.5, 0.5, 0]])
def test_slicing_finds_numbered_eigenvalues(spectrum):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    e = np.array([*spectrum, *([0] * 7)], float)
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    for s in (0.7, 2.0, 4.5):
        assert whitening.above(v, s) == (e > s).sum()
    found = whitening.leading(v, 4)
    assert len(found) == sum(x > 1e-14 for x in e[:4])
    for (theta, x), want in zip(found, e):
        assert abs(theta - want) < 1e-13 * e.sum() and np.linalg.norm(v @ x - theta * x) < 1e-13 * e.sum()
    u = np.array([x for _, x in found])
    assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-6


def test_indefinite_pivots():
    assert whitening.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.positive_pivots(np.zeros((3, 3))) == 0
