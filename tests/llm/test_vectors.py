import math
import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from genoplane.llm import nearest, whitening
from genoplane.llm.queries import op11_nearest_neighbours, op13_embedding_whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, list int, part int, x int, rank int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_nearest(rows, k, every):
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and usable(v) and any(v)]
    size = max((len(v) for _, v in kept), default=0)
    kept = [(i, np.pad(v, (0, size - len(v)))) for i, v in kept]
    out = {}
    for q, v in kept:
        if q % every == 0:
            out[q] = sorted(((-float((v * w).sum()), i) for i, w in kept if i != q))[:k]
    return {q: [(i, -s) for s, i in found] for q, found in out.items()}


def as_lists(result):
    got = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def same(got, expected):
    assert got.keys() == expected.keys()
    for q, found in expected.items():
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in found]
        assert [i for i, _ in got[q]] == [i for i, _ in found]


def random_rows(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, rng.standard_normal(dims).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 60, "query_rows": 3, "lists": 7}])
def test_all_lists_and_no_early_abandonment_is_brute_force(spark, options):
    hot = [0.5] * 20
    rows = random_rows(500, 20) + [(1000 + k, hot) for k in range(300)] + [(2000, None), (2020, [float("nan")] * 20), (2040, [0.0] * 20), (2060, [1.0, None]), (2080, []), (None, hot), (2100, [3.0, 1.0]), (7, hot), (7, hot)]
    got = as_lists(nearest.nearest(rows_of(spark, rows), k=20, every=20, share=1.0, epsilon=1e9, **options))
    same(got, brute_nearest(rows, 20, 20))


def test_fewer_candidates_than_k_and_small_tables(spark):
    rows = random_rows(6, 4)
    same(as_lists(nearest.nearest(rows_of(spark, rows), every=2)), brute_nearest(rows, 20, 2))
    assert nearest.nearest(rows_of(spark, [])).collect() == []
    assert nearest.nearest(rows_of(spark, [(0, [1.0])])).collect() == []
    assert nearest.nearest(rows_of(spark, [(1, [1.0]), (2, [2.0])]), every=20).collect() == []


def test_norms_far_apart_and_few_probes(spark):
    rows = [(i, [x * (1 + 30 * (i % 17 == 0)) for x in v]) for i, v in random_rows(800, 24, 3)]
    expected = brute_nearest(rows, 20, 20)
    got = as_lists(nearest.nearest(rows_of(spark, rows), every=20))
    assert all(len(v) == 20 for v in got.values()) and got.keys() == expected.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 20 * len(expected)
    few = as_lists(nearest.nearest(rows_of(spark, rows), every=20, share=0.01, lists=200))
    assert all(len(v) == 20 for v in few.values())


def test_query_recall_on_the_table(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    expected, got = brute_nearest(rows, 20, 20), as_lists(op11_nearest_neighbours(spark, SF))
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected) >= 0.9 * 20 * len(expected)
    by_id = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(abs(s - by_id[q] @ by_id[i]) < 1e-12 for q, found in got.items() for i, s in found)


def test_the_test_abandons_candidates_early():
    """Of clustered vectors, most partial distances are never completed, and nearly no near one is lost."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64)) * 2
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 64)) * 0.3).astype(np.float32)
    largest = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max()))
    ids, queries = np.arange(4000), vectors[:50]
    turn = nearest.rotation(65)
    counted = {}
    for epsilon in (nearest.EPSILON, 1e9):
        found, exact = nearest.Found(50, 20), []
        original = nearest.Found.add

        def count(self, rows, scores, own, exact=exact, original=original):
            exact.append(len(rows))
            original(self, rows, scores, own)

        nearest.Found.add = count
        try:
            nearest.scan(found, np.arange(50), ids[:50], queries, ids, vectors, largest, turn, epsilon)
        finally:
            nearest.Found.add = original
        counted[epsilon] = (sum(exact), found.ids.copy())
    assert np.mean([len(set(a) & set(b)) for a, b in zip(counted[nearest.EPSILON][1], counted[1e9][1], strict=True)]) >= 19.8


# whitening


def brute_whitening(rows):
    kept = [(i, v) for i, v in rows if usable(v)]
    size = max(len(v) for _, v in kept)
    x = {k: tuple(math.floor(256 * c) for c in v) + (0,) * (size - len(v)) for k, (_, v) in enumerate(kept)}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(size)]
    centred = np.array([[float(Fraction(v[d] * n - sums[d], n)) for d in range(size)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for k, (i, _) in enumerate(kept):
        away = np.array([float(Fraction(x[k][d] * n - sums[d], n)) for d in range(size)])
        exact = sum((n * x[k][d] - sums[d]) ** 2 for d in range(size))
        for c in range(min(4, size)):
            out.append((i, c + 1, n, exact, float(away @ vectors[:, c] / np.sqrt(values[c])), float(values[c] / values.sum())))
    return out


def check_whitening(got, rows):
    signs = {}
    expected = sorted(brute_whitening(rows), key=lambda r: (repr(r[0]), r[1], round(abs(r[4]), 6)))
    got = sorted(got, key=lambda r: (repr(r[0]), r[1], round(abs(r[4]), 6)))
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g[:4] == e[:4]
        if abs(e[4]) > 1e-6:
            assert abs(abs(g[4]) - abs(e[4])) < 1e-8
            assert signs.setdefault(e[1], math.copysign(1, g[4] * e[4])) == math.copysign(1, g[4] * e[4])
        assert abs(g[5] - e[5]) < 1e-9 and g[6] < 1e-9


def test_whitening_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1 + d) for d in range(7)]) for k in range(300)]
    rows += [(1000 + k, [0.25] * 7) for k in range(200)] + [(5, rows[3][1]), (None, rows[4][1]), (2000, None), (2001, [None] * 7), (2002, [float("inf")] * 7), (2003, [1.5, -2.5]), (2004, [])]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    check_whitening([tuple(r) for r in whitening.whiten(rows_of(spark, rows)).collect()], rows)


def test_whitening_query(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    check_whitening([tuple(r) for r in op13_embedding_whitening(spark, SF).collect()], rows)


def test_whitening_without_variance_and_small_tables(spark):
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    assert whitening.whiten(rows_of(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in one] == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)] or sorted(map(tuple, one), key=repr) == sorted([(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)], key=repr)
    huge = whitening.whiten(rows_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None}


def test_deviation_is_exact_beyond_doubles():
    x = np.array([[3 << 30, -(5 << 29)], [1, 2]])
    sums = [(3 << 30) + 1, 2 - (5 << 29)]
    assert whitening.deviations(x, 2, sums) == [v if v < 1 << 63 else None for v in (sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x)]


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    scale = 10.0 ** np.arange(0, -24, -3)
    a = rng.standard_normal((8, 8)) * 0.1 + np.eye(8)
    graded = (a @ a.T) * np.outer(scale, scale)
    values, vectors = whitening.jacobi(graded)
    assert list(values) == sorted(values, reverse=True)
    residual = graded @ vectors - vectors * values
    # Small relative to each entry's own scale, not only to the largest.
    assert (np.abs(residual) <= 1e-13 * np.outer(scale, scale).max(axis=1)[:, None] * np.abs(values).max() ** 0.5 + 1e-30).all() or np.abs(residual).max() < 1e-14
    product = np.prod(values / scale**2)
    assert abs(product / np.linalg.det(a @ a.T) - 1) < 1e-10
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    assert whitening.jacobi(np.zeros((2, 2)))[0].tolist() == [0.0, 0.0]
