import random

from corpusprep.llm import line_winnow


def words(r, n):
    return " ".join("w%d" % r.randrange(10**6) for _ in range(n))


def lines_left(rows):
    return {i: (t or "").split("\n") for i, t in rows}


def test_planted_passages_go_and_clean_lines_stay(spark):
    r = random.Random(11)
    rows, planted = [], []
    passages = [[words(r, k) for k in ks] for ks in ([60], [10, 15, 26], [3] * 20, [30, 30, 30], [1] * 60, [24, 24, 5], [200, 2, 3])]
    for i in range(120):
        mine, at = [], r.randrange(len(passages))
        for _ in range(r.randint(1, 4)):
            mine.append(words(r, r.randint(1, 40)))
        k = r.randrange(len(mine) + 1)
        if i % 2:
            mine[k:k] = passages[at]
            planted.append((i, at))
        rows.append((i, "\n".join(mine), "x", i))
    short = "Licensed under the same licence as ever."
    rows = [(i, t + "\n\n" + short, x, n) for i, t, x, n in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, pos int").repartition(4)
    got = {o.doc_id: o for o in line_winnow.delete_repeats(df).collect()}
    assert len(got) == len(rows)
    seen = set()
    for i, t, _, _ in rows:
        left = got[i].text.split("\n")
        was = t.split("\n")
        at = dict(planted).get(i)
        repeat = at is not None and at in seen
        seen.add(at)
        for line in was:
            if repeat and line in passages[at]:
                assert line not in left, (i, at, line)
            elif line and (line != short or not repeat):  # the licence may go as the end of a repeated run
                assert line in left, (i, at, line)
        gone = [k for s in got[i].removed for k in range(s.s, s.e + 1)]
        assert left == [x for k, x in enumerate(was) if k not in gone] or (not left[0] and len(gone) == len(was))


def test_ends_that_only_later_holders_share(spark):
    """60 words in every document; on both sides a few lines that only some of the later ones have, and longer ones only two of these."""
    r = random.Random(13)
    rows, want, i = [], {}, 0
    for case in range(12):
        own = lambda: words(r, 30)
        body, near, far, head = words(r, 60), [words(r, 6)] * 1 + [words(r, 5)], [words(r, 7)], [words(r, 4), words(r, 8)]
        body = body.split(" ")
        body = [" ".join(body[k:k + 12]) for k in range(0, 60, 12)]
        for before, after, gone in (([], [], 0), (head, near, 5), ([], near[:1], 6), (head[1:], near + far, 5 + 1 + 2), ([], [], 5), (head, near + far, 5 + 2 + 3)):
            rows.append((i, "\n".join([own(), *before, *body, *after, own()])))
            want[i] = gone
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {o.doc_id: sum(x.e - x.s + 1 for x in o.removed) for o in line_winnow.delete_repeats(df).collect()}
    assert got == want


def test_edges(spark):
    r = random.Random(12)
    body = "\n".join(words(r, 12) for _ in range(12))
    loop = "\n".join([words(r, 9)] * 2000)
    big = "\n".join(words(r, 8) for _ in range(20_000))
    rows = [(1, body), (2, body), (2, body), (3, "head\n" + body.replace("\n", "\r\n") + "\ntail"), (None, None), (4, ""), (5, "\n\n"), (6, loop), (7, big), (7, "own text here"), (None, body + "\nnew end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(o.doc_id, o.text) for o in line_winnow.delete_repeats(df).collect()]
    assert len(out) == len(rows)
    # a null id comes first, so its copy stays
    assert (None, body + "\nnew end") in out and (None, None) in out and (1, "") in out
    assert out.count((2, "")) == 2 and (3, "head\ntail") in out and (4, "") in out and (5, "\n\n") in out
    assert (7, big) in out and (7, "own text here") in out
    kept = [t for i, t in out if i == 6][0].split("\n")
    assert 1 <= len(kept) <= 3 and set(kept) == {loop.split("\n")[0]}
    assert line_winnow.delete_repeats(df.where("false")).count() == 0
