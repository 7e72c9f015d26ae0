import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.llm import pivot_distance as V


def brute(rows, is_query, k):
    """rows: (id, vector or None). The rule of the docstring, pair by pair, in whole numbers of any size."""
    kept = set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = tuple(int(np.floor(x * 256)) for x in map(float, v))
        if sum(x * x for x in w) <= V.GREATEST:
            kept.add((i, w))
    out = {}
    for q, v in kept:
        if is_query(q):
            out.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q and len(w) == len(v))
    return {q: [(i, -s) for s, i in sorted(r)[:k]] for q, r in out.items() if r}


def run(spark, rows, k=5, every=10, **how):
    df = spark.createDataFrame([(i, v, "x", 1.5) for i, v in rows], "vec_id long, embedding array<double>, far string, score double").repartition(4)
    got = {}
    for r in V.search(df, F.expr(f"id % {every} = 0"), k=k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.fixture
def small_pages(monkeypatch):
    monkeypatch.setattr(V, "PAGE", 16)
    monkeypatch.setattr(V, "BLOCK", 8)


def test_equals_brute_force_on_uneven_lengths(spark, small_pages):
    r = np.random.default_rng(1)
    for spread in (0, 1.0):
        x = r.normal(size=(500, 12)) * np.exp(spread * r.normal(size=(500, 1)))
        x[77] *= 50
        rows = [(i + 3, v.tolist()) for i, v in enumerate(x)]
        assert run(spark, rows, partitions=3) == brute(rows, lambda i: i % 10 == 0, 5)


def test_ties_copies_and_bad_rows(spark, small_pages):
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (240, 4)) / 4.0  # many equal products
    x[60:160] = x[3]  # a third and more of all rows
    nan, inf = float("nan"), float("inf")
    bad = [(400, None), (410, []), (420, [0.0] * 4), (430, [1.0, None, 1.0, 1.0]), (440, [nan] * 4), (450, [inf, 1.0, 1.0, 1.0]), (460, [1.0, 2.0]), (470, [2.0, 2.0]),
           (480, []), (None, [1.0] * 4), (20, x[20].tolist()), (20, x[21].tolist()), (7, x[30].tolist()), (490, [1e300] * 4), (500, [-1e200, 1.0, 1.0, 1.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0, 5)
    assert got[410] == [(480, 0)] and got[460] == [(470, 4 * 256 * 256 + 2 * 256 * 256)] and 420 in got and 400 not in got and 490 not in got


def test_products_beyond_doubles(spark, small_pages):
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-10**6, 10**6, 6) * (1.0 + 2.0 ** -8)).tolist()) for i in range(200)]
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert max(s for v in want.values() for _, s in v) > 2 ** 53
    assert run(spark, rows) == want


def test_few_rows_and_none(spark):
    assert run(spark, []) == {} and run(spark, [(10, [1.0])]) == {}
    rows = [(10, [1.0, 0.0]), (11, [0.5, 0.0]), (12, [-0.001, 0.0])]
    assert run(spark, rows) == {10: [(11, 256 * 128), (12, -256)]}


def test_bounds_spare_rings(spark, small_pages, monkeypatch):
    """Groups far from each other: most rings can't reach the k-th best product."""
    r = np.random.default_rng(4)
    x = np.repeat(np.eye(16) * 20, 60, 0) + r.normal(size=(960, 16)) * .1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    seen = {}
    write = V.materialize

    def counted(df, name):
        out = write(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(V, "materialize", counted)
    assert run(spark, rows, partitions=4) == brute(rows, lambda i: i % 10 == 0, 5)
    assert seen["visits"] < .3 * seen["queries"] * seen["pages"]


def test_page_bounds_never_cut_a_best_row():
    r = np.random.default_rng(5)
    for _ in range(60):
        x = r.integers(-50, 50, (40, 3))
        pivot = r.integers(-50, 50, (1, 3))
        d = V.distances(x, pivot)[:, 0]
        x, d = x[np.argsort(d)], np.sort(d)
        q = r.integers(-50, 50, (5, 3))
        score = q @ x.T
        least = np.sort(score, 1)[:, -3].astype(float)
        top = int((x * x).sum(1).max())
        rows, found, scores = V.best_of_page(x, d, top, np.arange(40), np.ones(40, int), np.full(5, -1), q, V.distances(q, pivot)[:, 0], least, 3)
        for i in range(5):
            assert list(zip(-scores[rows == i], found[rows == i])) == sorted((-s, j) for j, s in enumerate(score[i]))[:3]
        far = V.distances(q, pivot)[:, 0]
        gap = np.maximum(np.maximum(far - d[-1], d[0] - far), 0)
        assert (V.bound((q * q).sum(1), np.array([top]), gap) >= score.max(1)).all()
