"""Bit-parallel edit distance of long pairs."""

import random
import time

from pyspark.sql import functions as F

from corpusprep.functions import edit as E


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_equals_the_distance_table(monkeypatch):
    r = random.Random(4)
    for block in (1, 2, 7, 64, E.BLOCK):
        monkeypatch.setattr(E, "BLOCK", block)
        for letters in ("ab", "abcdefgh", "a\U0001F600\u00e9\ud800"):
            for _ in range(60):
                a, b = ("".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(2))
                assert E.bit_distance(a, b) == dp(a, b), (block, a, b)


def test_long_pair_in_seconds():
    r = random.Random(5)
    a = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=100_000))
    b = a[:30_000] + "XY" + a[30_001:70_000] + a[70_010:]
    start = time.process_time()
    assert E.bit_distance(a, b) == 12
    assert time.process_time() - start < 120


def test_both_forms_in_one_column(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choices("abc", k=n)), "".join(r.choices("abc", k=m))) for i, (n, m) in enumerate([(0, 9), (40, 50), (4200, 4100), (4000, 4300), (9000, 0), (3, 3)])]
    df = spark.createDataFrame([*rows, (9, None, "a"), (10, "a" * 5000, None)], "k int, a string, b string")
    got = df.select("k", E.char_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("want")).collect()
    assert len(got) == 8 and all(g.d == g.want for g in got)
    words = [(0, " ".join(f"w{r.randint(0, 9)}" for _ in range(4200)), " ".join(f"w{r.randint(0, 9)}" for _ in range(4100))), (1, "a b", "b"), (2, None, "b")]
    out = {x.k: x for x in E.with_word_distance(spark.createDataFrame(words, "k int, a string, b string"), "a", "b").collect()}
    stand_ins = ["".join(chr(97 + int(w[1:])) for w in t.split()) for t in words[0][1:]]
    assert out[0].word_edits == E.bit_distance(*stand_ins) and out[1].word_edits == 1 and out[2].word_edits is None
