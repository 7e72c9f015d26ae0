import math
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from corpusprep.llm import bound_packing as B

PATH = P.path("word_bpe_49k.json")


def least_bins(sizes, capacity):
    """Exact, by search; for a few pieces only."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


def test_bound_never_exceeds_the_optimum():
    r = random.Random(1)
    for _ in range(400):
        c = r.choice([10, 12, 30, 100])
        x = [r.randint(1, c) for _ in range(r.randint(1, 9))]
        low, opt = B.lower_bound(np.array(x), c), least_bins(x, c)
        where, offset, room = B.best_fit_decreasing(np.array(x), c)
        assert math.ceil(sum(x) / c) <= low <= opt <= len(room), (c, x)
        for b in range(len(room)):
            mine = sorted((offset[i], x[i]) for i in range(len(x)) if where[i] == b)
            at = 0
            for o, n in mine:
                assert o == at
                at += n
            assert at == c - room[b]
    assert B.lower_bound(np.array([6] * 9), 10) == 9 and B.lower_bound(np.array([4] * 9), 10) == 5


def test_tokens_match_the_library():
    t = Tokenizer.from_file(PATH)
    r = random.Random(2)
    texts = ["", " ", "A b\tC\n\nd é É é <|endoftext|> it's I'LL ΑΣ Σ", "x" * 500, "a b c\u0085d", "́ a"]
    texts += ["".join(r.choice("aB 'sé\n\t1.!　あ́ΣİK​\x1c\x85") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for s, raw in zip(texts, B.WordTokens(PATH).encode(texts, b"")):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_a_worker_keeps_few_words_and_splits_little_text_at_a_time(monkeypatch):
    monkeypatch.setattr(B, "CACHE_WORDS", 4000)
    monkeypatch.setattr(B, "STEP_CHARS", 5000, raising=False)
    t, r = Tokenizer.from_file(PATH), random.Random(3)
    word = lambda: "".join(r.choice("abcdeé'1") for _ in range(r.randint(1, 7))) + r.choice(["", "", ",", "."])
    texts = [" ".join(word() for _ in range(200)) for _ in range(200)] + [" ".join(word() for _ in range(2000))]
    tokens, asked = B.WordTokens(PATH), []
    caches = [c for c in vars(tokens).values() if isinstance(c, B.Generations)]
    for c in caches:
        monkeypatch.setattr(c, "of", lambda keys, of=c.of: asked.append(len(keys)) or of(keys))
    most = 0
    for s, raw in zip(texts, tokens.encode(texts, b"")):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s
        most = max(most, sum(len(c.new) + len(c.old) for c in caches))
    # formerly two caches of so many entries each, and the words of 400 texts whatever their lengths
    assert most <= 4000 and max(asked) <= 2000, (most, max(asked))


def check(rows, out, capacity=2048):
    seqs = {}
    for o in out:
        seqs.setdefault(o.sequence_id, []).append((o.offset, o.length))
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_pack_pieces(spark):
    t = Tokenizer.from_file(PATH)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "b", "Gamma"]) for _ in range(r.choice([3, 40, 900, 5000]))), 1) for i in range(60)]
    rows += [(None, "x", 2), (2**60 + 1, None, 2), (100, "", 2), (101, "same", 3), (101, "same", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    out = B.pack(B.cut_pieces(df, PATH)).collect()
    check(rows, out)
    by = {}
    for o in out:
        by.setdefault(o.doc_id, []).append(o)
    assert sum(o.length for o in out) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows)
    for i, x, _ in rows:
        if i == 101:
            assert len(by[i]) == 2
            continue
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        mine = sorted(by[i], key=lambda o: o.piece)
        assert [o.start for o in mine] == list(range(0, len(ids), 2048))
        for o in mine:
            assert bytes(o.ids) == ids[o.start:o.start + 2048].tobytes() and o.length == len(o.ids) // 4
    empty = df.where("false")
    assert B.pack(B.cut_pieces(empty, PATH)).count() == 0


def test_exchange_reaches_the_bound(spark):
    sizes = spark.range(6000).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(500)) + 60).cast("long").alias("length")).repartition(12)
    x = np.array([r.length for r in sizes.collect()])
    n = check(None, B.pack(sizes, 1000, block_rows=500, loose_bins=24).collect(), 1000)
    low = B.lower_bound(x, 1000)
    one = len(B.best_fit_decreasing(x, 1000)[2])
    alone = sum(len(B.best_fit_decreasing(x[k:k + 500], 1000)[2]) for k in range(0, 6000, 500))
    assert low <= n < alone and n <= one * 1.005, (low, n, one, alone)
