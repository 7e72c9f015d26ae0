import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusprep.llm import periodic_runs as P
from corpusprep.llm import queries


def brute(words, least=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_texts(r):
    out = []
    for _ in range(r.randint(1, 6)):
        n, k = r.choice([0, 1, 2, 5, 6, 8, 20, 60, 200]), r.choice([1, 2, 2, 3, 5])
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < .5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if r.random() < .3:  # runs inside the periods of a run
            u, v = [r.randrange(3) for _ in range(r.randint(1, 3))], [r.randrange(4) for _ in range(r.randint(1, 4))]
            w = w + (u * r.randint(1, 9) + v) * r.randint(3, 8)
        out.append([b"%d" % x for x in w])
    return out


@pytest.mark.parametrize("least,times", [(6, 4), (4, 4), (10, 5)])
def test_runs_are_those_of_brute_force(least, times):
    r = random.Random(least)
    for _ in range(150):
        texts = some_texts(r)
        for words, (found, stay) in zip(texts, P.search(texts, least, times)):
            want = brute(words, least, times)
            assert [tuple(x) for x in found.tolist()] == want
            assert stay == collapsed(words, want)


def test_one_text_is_found_alike_alone_and_among_others(monkeypatch):
    texts = some_texts(random.Random(5)) * 3
    alone = [P.search([t])[0] for t in texts]
    for size in (1, 50, 10_000):
        monkeypatch.setattr(P, "TOGETHER", size)
        for a, b in zip(alone, P.search(texts)):
            assert a[0].tolist() == b[0].tolist() and a[1] == b[1]


def test_range_successor():
    r = np.random.default_rng(3)
    values = r.permutation(100)
    tree = P.Wavelet(values, 7)
    for _ in range(200):
        low = int(r.integers(0, 99))
        high, a = int(r.integers(low + 1, 101)), int(r.integers(0, 100))
        ordered = sorted(values[low:high].tolist())
        k = tree.below(np.array([low]), np.array([high]), np.array([a]))
        assert k[0] == sum(v < a for v in ordered)
        if k[0] < high - low:
            assert tree.ordered(np.array([low]), np.array([high]), k)[0] == min(v for v in ordered if v >= a)


def test_long_texts_and_one_word_repeated():
    r = random.Random(9)
    words = [b"w%d" % r.randrange(50) for _ in range(120_000)]
    words[1000:61000] = [words[1000 + i % 7919] for i in range(60000)]  # a long period
    found, stay = P.search([words])[0]
    assert [q for _, _, q in found.tolist()].count(7919) == 1
    assert len(stay) <= len(words) - 60000 + 7919
    assert P.search([[b"a"] * 200_000])[0][0].tolist() == [[0, 200_000, 1]]
    with pytest.raises(ValueError):
        P.runs(np.zeros(9, np.int64), np.array([9]), times=3)


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "x x x x x x"), (4, "x x x x x x"), (None, "a b a b a b a b"), (5, "a b a b\va b\fa b\ra b a b"),
         (6, "é \U0001f600 " * 9 + "end"), (7, "a a a a a")]


def test_edge_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in EDGES], "doc_id long, text string, runs string, start int").repartition(3)
    got = P.find_runs(df, id_col="doc_id").collect()
    assert len(got) == len(EDGES) and set(got[0].asDict()) == {"doc_id", "text", "runs", "start", "collapsed"}
    for row in got:
        words = [w.decode() for w in (row.text or "").encode().split()]
        assert [tuple(r) for r in row.runs] == brute(words)
        assert row.collapsed == " ".join(collapsed(words, brute(words)))
    assert P.find_runs(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_dir):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(80)))) for i in range(200)] + [(500, None), (500, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = {(x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256)
           for x in queries.REGISTRY["op12_periodic_runs"](spark, tmp_dir).collect()}
    want = set()
    for i, t in rows:
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        n = len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        found = brute(words)
        s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(collapsed(words, found)))]
        want.add((i, len(found), s, n, q, 1000 * n // q if q else None, *digest))
    assert got == want
