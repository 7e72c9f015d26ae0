import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusprep.llm import line_quality, simhash_tiles

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(t):
    t = t or ""
    w = W.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))


def texts(seed=3, n=60):
    r = random.Random(seed)
    out = [None, "", " \t\n ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a\nb\na\n\n\na\r\n", "é é é"]
    for _ in range(n):
        out.append("".join(r.choice(["a", "b", "c d", "é", "#", "|", "fur\f"]) + r.choice([" ", " ", "\n", "\t", " ", "\x0b"]) for _ in range(r.randint(1, 120))))
    return out + [" ".join("w%d" % (i % 97) for i in range(30_000))] + out[3:8]


def test_quality_counts_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), (i, t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_line_rules(spark):
    good = " ".join(f"The river{i} runs past mill{i}, and path{i} follows it{i}." for i in range(12))
    nav = "\n".join("Home | News | Sport | Weather | Contact" for _ in range(30))
    rows = [(1, good), (2, good + "\nAll rights reserved."), (3, good + nav), (4, " ".join(f"word{i}### other{i}*** third{i}$$$" for i in range(30)) + ".")]
    got = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == good
    assert got[2].kept and got[2].clean_text == good and got[2].n_failed_lines == 1
    assert not got[3].kept and not got[4].kept
    empty = line_quality.judge(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def brute_fingerprint(t):
    w = W.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_against_brute_force():
    for t in texts() + ["ÀB c D", "one two"]:
        assert simhash_tiles.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(fps))]


def test_links_find_every_pair(spark):
    r = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(x)
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
    fps += [1 << b for b in range(64)]  # one long run
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(3)
    want = brute_components(fps)
    for hot in (100_000, 7):
        got = dict(simhash_tiles.components(simhash_tiles.fingerprint_links(rows, hot_run=hot)).collect())
        signed = {int(np.uint64(f).astype(np.int64)): k for k, f in enumerate(fps)}
        groups = [signed[got.get(f, f)] for f in signed]
        assert {frozenset(i for i, g in enumerate(groups) if g == k) for k in set(groups)} == \
            {frozenset(i for i, g in enumerate(want) if g == k) for k in set(want)}


def test_tiles_find_every_pair_of_runs_of_any_length():
    r = np.random.default_rng(3)
    for sizes in ([1], [2], [1] * 70, [31, 1, 33], [200], [5, 64, 1, 1, 300, 2, 2, 2], [32, 32]):
        fp, run = [], []
        for k, size in enumerate(sizes):
            base = r.integers(0, 2**64, dtype=np.uint64)
            x = np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, r.integers(1, 6), dtype=np.uint64)) for _ in range(size)])
            fp.append(x[np.argsort(np.bitwise_count(x), kind="stable")])
            run += [k] * size
        fp, run = np.concatenate(fp), np.array(run)
        got = [p for x, y in simhash_tiles.near_pairs(run, fp, 2) for p in zip(x.tolist(), y.tolist())]
        want = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if run[i] == run[j] and int(fp[i] ^ fp[j]).bit_count() <= 2]
        assert sorted(got) == want


def test_near_duplicates_edges(spark):
    long = " ".join("word%d" % i for i in range(300))
    rows = [(9, long, 1), (4, long, 2), (4, long, 2), (7, long.upper(), 3), (1, None, 4), (2, "", 5), (None, long, 6), (None, "only this here now", 7), (3, "short", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash_tiles.near_duplicates(df).collect()
    assert len(got) == 9
    by = {(r.id, r.component_id) for r in simhash_tiles.near_duplicates(df).collect()}
    assert by == {(9, 4), (4, 4), (7, 4), (1, 1), (2, 1), (None, 4), (None, None), (3, 3)}
    kept = simhash_tiles.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, 7), (1, 4), (3, 8), (4, 2)]
    assert simhash_tiles.near_duplicates(df.where("false")).count() == 0
    assert simhash_tiles.keep_first(df.where("false")).count() == 0


def test_lines_that_end_in_other_scripts_marks_are_punctuated(spark):
    from corpusprep.llm import line_quality

    lines = ["هل هذا سطر كامل من الكلام هنا؟", "यह एक पूरी पंक्ति है जो यहाँ है।", "This line has five words at least!"]
    rows = [(i, "\n".join([x] * 3 + [f"{x} {k}" for k in range(9)])) for i, x in enumerate(lines)]
    got = {r.doc_id: r.n_failed_lines for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    bare = line_quality.judge(spark.createDataFrame([(1, "five words without any mark")], "doc_id long, text string")).first()
    assert bare.n_failed_lines == 1
