import numpy as np
from pyspark.sql import functions as F

from corpusprep.llm import cross_polytope as C


def brute(ids, x, is_query, k):
    out = {}
    for i in np.flatnonzero([is_query(n) for n in ids]):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def run(spark, ids, x, k=10, extra=(), **how):
    rows = [(int(i), [float(a) for a in v], 5) for i, v in zip(ids, x)] + list(extra)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    got = {}
    for r in C.search(df, F.expr("id % 20 = 0"), k=k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({a for a, _ in got.get(q, [])} & {a for a, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    for scale in (np.ones((1500, 1)), r.uniform(.2, 3, (1500, 1))):
        x = r.normal(size=(1500, 48)).astype(np.float32)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True) * scale).astype(np.float32).astype(float)
        ids = np.arange(1500) + 7
        got, want = run(spark, ids, x, chunk=100), brute(ids, x, lambda n: n % 20 == 0, 10)
        assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
        assert recall(got, want) >= 0.9
        where = {int(i): v for i, v in zip(ids, x)}
        for q, g in got.items():
            for i, s in g:
                assert abs(s - float(where[q] @ where[i])) < 1e-12
            assert g == sorted(g, key=lambda a: (-a[1], a[0]))


def test_recall_on_uneven_lengths(spark):
    """Lengths that differ much, and one vector that is 50 times longer than the others."""
    r = np.random.default_rng(8)
    n = 3000
    for lengths in (np.exp(.3 * r.normal(size=n)), np.exp(r.normal(size=n)), np.exp(1.5 * r.normal(size=n)), np.where(np.arange(n) == 11, 50., 1.)):
        x = r.normal(size=(n, 64))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True) * lengths[:, None]).astype(np.float32).astype(float)
        ids = np.arange(n)
        got, want = run(spark, ids, x, k=20), brute(ids, x, lambda i: i % 20 == 0, 20)
        assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_ranges_of_lengths():
    x = np.random.default_rng(9).normal(size=(50, 8)) * np.logspace(-150, 150, 50)[:, None]
    member, query = C.to_sphere(x, False, False), C.to_sphere(x, False, True)
    assert np.allclose((member * member).sum(1), 1) and np.allclose((query * query).sum(1), 1)
    assert (member[:, -1] < .31).all() and (query[:, -1] == 0).all()
    cos = (member[:, :-1] * query[:, :-1]).sum(1)
    assert (cos > .95).all()


def test_ties_copies_and_bad_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 16)).astype(np.float32).astype(float)
    x[100:220] = x[3]  # one vector on more than a third of the rows
    ids = np.arange(300)
    nan, inf = float("nan"), float("inf")
    bad = [(400, None, 1), (420, [], 1), (440, [0.0] * 16, 1), (460, [1.0] * 15 + [None], 1), (480, [nan] * 16, 1), (500, [inf] * 16, 1), (520, [1.0] * 5, 1), (None, [1.0] * 16, 1), (20, [float(a) for a in x[20]], 1)]
    got, want = run(spark, ids, x, k=20, extra=bad), brute(ids, x, lambda n: n % 20 == 0, 20)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    for q in (100, 120, 140, 160, 180, 200):
        # its copies come first, by id; the query itself is left out
        same = [i for i in [3, *range(100, 220)] if i != q]
        best = [(i, s) for i, s in want[q]]
        assert [i for i, _ in got[q]] == [i for i, _ in best] == same[:20]


def test_few_rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(9, 24)).astype(np.float32).astype(float)
    ids = np.arange(9) * 20
    got, want = run(spark, ids, x, k=20), brute(ids, x, lambda n: True, 20)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert C.search(one, F.expr("id % 20 = 0")).count() == 0
    assert C.search(one.where("false"), F.expr("true")).count() == 0


def test_several_functions(spark):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(60, 16)), 10, 0) + r.normal(size=(600, 16)) * .05
    x = x.astype(np.float32).astype(float)
    ids = np.arange(600)
    got, want = run(spark, ids, x, k=5, functions=2, probes=24), brute(ids, x, lambda n: n % 20 == 0, 5)
    assert recall(got, want) >= 0.9


def test_recall_of_several_functions_as_by_default():
    r = np.random.default_rng(5)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = np.argsort(-(x[:20] @ x.T), 1)[:, 1:21]
    for functions in (1, 2):
        hit = np.zeros(top.shape, bool)
        for t in range(C.TABLES):
            own = C.buckets(x[top.ravel()], t, functions, 1).reshape(20, 20)
            probed = C.buckets(x[:20], t, functions, C.default_probes(functions))
            hit |= (own[:, :, None] == probed[:, None, :]).any(2)
        assert hit.mean() >= 0.9


def test_best_pairs_of_axes():
    x = np.random.default_rng(6).normal(size=(20, 8))
    both = [np.concatenate([y, -y], 1) for y in (C.rotate(x, 6), C.rotate(x, 7))]
    value = (both[0][:, :, None] + both[1][:, None, :]).reshape(20, -1)
    for probes in (1, 5, 24, 256, 300):
        got = C.buckets(x, 3, 2, probes)
        assert all(len(set(g)) == min(probes, 256) for g in got.tolist())
        assert np.allclose(np.take_along_axis(value, got, 1), -np.sort(-value, 1)[:, :probes])


def test_many_equal_scores_and_extreme_lengths(spark):
    """Different vectors of one equal score: the smaller ids win, however many tie in a bucket."""
    q = [0.5, 0.5] + [0.0] * 14
    tied = []
    for i in range(14):  # the same product with q, another vector each
        for sign in (-1, 1):
            for a in (0.25, 0.5, 0.125):
                v = [0.75, 0.25] + [0.0] * 14
                v[2 + i] = sign * a
                tied.append(v)
    rows = [(0, q)] + [(1001 + 2 * i, v) for i, v in enumerate(tied)]
    df = spark.createDataFrame(rows + [(2000, [1e200] + [0.0] * 15), (2020, [1e-200] + [0.0] * 15)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in C.search(df, F.expr("id % 20 = 0"), k=10).where("query_id = 0").orderBy("rank").collect()]
    assert got == [1001 + 2 * i for i in range(10)]
    assert C.search(df, F.expr("id % 20 = 0"), k=10).where("query_id in (2000, 2020)").count() == 0
