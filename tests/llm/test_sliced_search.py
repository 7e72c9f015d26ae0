import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusprep.llm import sliced_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """docs, items: (id, text). The contract's rule, document by document."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=5):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, df int").repartition(5)
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, score int")
    return sorted((tuple(r) for r in S.search(d, q, k=k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(r, n, words=300):
    out = []
    for i in range(n):
        size = r.choice([1, 5, 30, 30, 100, 400])
        out.append((i * 3, " ".join(r.choice(["W", "w", "é"]) + str(min(int(r.paretovariate(.7)), words)) for _ in range(size))))
    return out


def test_terms_are_those_of_the_pattern():
    r = random.Random(1)
    marks = [chr(c) for c in range(128)] + ["é", "É", "ß", " ", "\xa0", "\U0001f600", "一", "K"]
    for _ in range(300):
        text = "".join(r.choice(marks) for _ in range(40))
        assert [t.decode() for t in S.terms_of(text)] == terms(text)


@pytest.mark.parametrize("bits", [24, 2])  # 2: half of all pairs seem to be everywhere, which must not change the result
def test_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "BITS", bits)
    monkeypatch.setattr(S, "DOCS", 16)
    monkeypatch.setattr(S, "ITEM_BYTES", 400)
    r = random.Random(bits)
    docs = corpus(r, 150)
    docs += [(1000 + i, docs[4][1]) for i in range(60)]  # copies: ties by the smaller id
    items = [(i, " ".join(r.choices(docs[r.randrange(100)][1].split(), k=6))) for i in range(12)]
    assert run(spark, docs, items) == brute(docs, items, 5)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,! "), (4, "Alpha beta"), (4, "Alpha beta"), (4, "gamma"), (None, "alpha alpha delta"), (5, "delta " * 30_000), (6, "É é"), (-7, "beta9 0x")]
    items = [(1, "alpha"), (2, None), (3, "..."), (4, "nothing like it"), (5, "ALPHA delta delta"), (5, "ALPHA delta delta"), (5, "gamma"), (None, "É beta9"), (7, "beta " * 3000)]
    assert run(spark, docs, items) == brute(docs, items, 5)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_bounds_are_never_below_scores():
    r = random.Random(3)
    for _ in range(20):
        docs = corpus(r, 40)
        counts = [Counter(S.terms_of(t)) for _, t in docs]
        block = S.Block()
        for (i, _), c in zip(docs, counts):
            pairs = [(S.pair_hash(t), j) for t, n in c.items() for j in range(len(S.STEPS)) if j == 0 or n > S.STEPS[j - 1]]
            block.add(i, sum(c.values()), [h for h, _ in pairs], [j for _, j in pairs])
        row = block.row()
        items = S.Items([(9, [(t.decode(), r.randrange(1, 9000), r.randrange(1, 4)) for t in list(counts[0] | counts[1])])], 40, sum(sum(c.values()) for c in counts))
        for number, bound in items.bounds(row["n_rows"], row["slices"], np.frombuffer(row["sizes"], "<i8")):
            exact = [items.score(number, c, sum(c.values())) for c in counts]
            assert all(b >= s for b, s in zip(bound.tolist(), exact))
            assert sum(b > 3 * s + 10 ** 6 for b, s in zip(bound.tolist(), exact)) < 10  # and not far above
