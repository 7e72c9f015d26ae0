import pickle
import random
import zlib

from corpusprep.llm import lev_toxicity as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(1)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(4, 8))): (1.0, r.random() < .4, r.random() < .8) for _ in range(40)}
    trie = T.Trie(terms)
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(3, 9)))
        want = set()
        for t, (_, stem, fuzzy) in terms.items():
            e = edits(t, w)
            if w.startswith(t) if stem else e <= (1 if fuzzy and len(t) >= T.FUZZY else 0):
                want.add((0 if stem else e, t))
        assert {(e, t) for e, _, t in trie.matches(w)} == want, w


def test_context_and_pickling():
    m = T.Model(terms={"idiot": (5.0, False, True), "lowei": (4.0, True, False)}, weights=(-3, 2.5, 2.5, -1, .5, 1))
    m = pickle.loads(pickle.dumps(m))
    assert m.score("you are an idiot") > .7 and m.score("you are an id1ot, idoit no idio") > .7
    assert m.score("He said \"idiot\" to them, as the word was then.") < .3 < m.score("what an idiot")
    assert m.score("") == m.score("nothing here") < .1 and m.score("loweischaft") > .7
    assert m.score("x " * 50_000 + "idiot") > .7  # the end of a long text counts


def test_fit_on_labels(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = ["w%d" % r.randrange(400) for _ in range(r.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["grobian", "lummelei", "lummelkopf", "scoundrel"]))
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    rows += [(None, "grobian", 1), (5000, None, 1), (5001, "", 1), (5001, "", 1), (5002, "such a grobiam and scoundrell", 1)]
    labels += [(None, 1), (7, None), (900_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = T.fit(docs, lab)
    assert any(t.startswith("lummel") and stem for t, (_, stem, _) in m.terms.items()) and "grobian" in m.terms
    out = docs.select("doc_id", "text", T.held_out().alias("h"), T.score_column(m).alias("s")).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    for o in out:
        assert o.h == (o.doc_id is not None and zlib.crc32(str(o.doc_id).encode()) % 3 == 1) and 0 <= o.s <= 1
        if o.doc_id is not None and o.doc_id < 900 and o.doc_id != 7:
            assert (o.s >= .7) == bool(truth[o.doc_id]), o
    by = {o.doc_id: o.s for o in out}
    assert by[5000] == by[5001] < .5 and by[5002] >= .7 and by[None] >= .7
    for none in (lab.where("false"), lab.where("toxic = 0")):
        low = T.fit(docs, none)
        assert not low.terms and low.score("grobian") < .5
    assert docs.where("false").select(T.score_column(m)).count() == 0


def test_near_stems_against_edit_distance():
    r = random.Random(7)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(4, 8))): (1.0, r.random() < .6, True) for _ in range(30)}
    trie = T.Trie(terms)
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(3, 11)))
        want = {t for t, (_, stem, _) in terms.items() if stem and len(t) >= T.FUZZY and min(edits(t, w[:k]) for k in range(len(w) + 1)) == 1}
        assert {t for _, _, t in trie.near_stems(w)} == want, w


def test_look_alikes_in_clean_rows_are_the_only_exceptions(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = ["w%d" % r.randrange(400) for _ in range(r.randint(5, 60))]
        if i % 6 == 0:
            words.insert(r.randrange(len(words)), r.choice(["loser", "lummelei", "lummelkopf"]))
        else:
            words.append(["lower", "closer", "poser", "w1", "w2"][i % 5])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    m = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"lower", "closer", "poser"} & set(m.exceptions) and "loser" in m.terms
    assert m.score("what a looser, l0ser and losr") >= .7 > .3 > m.score("lower and closer, says the poser")
    assert any(t.startswith("lummel") and stem for t, (_, stem, _) in m.terms.items())
    assert m.score("what a lumnelkopf") >= .7


def test_a_repeated_id_is_one_example(spark):
    rows = [(i, f"grobian w{i % 50} and more" if i % 4 == 0 else f"w{i % 50} and more") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    one = spark.createDataFrame(rows, "doc_id long, text string")
    k = next(i for i in range(400) if i % 4 and zlib.crc32(str(i).encode()) % 3 != 1)  # a clean one, learned from
    many = one.unionByName(spark.createDataFrame([rows[k]] * 500, "doc_id long, text string"))
    a, b = T.fit(one, labels), T.fit(many.repartition(3), labels)
    assert a.terms == b.terms and a.terms and a.exceptions == b.exceptions and max(abs(x - y) for x, y in zip(a.weights, b.weights)) < 1e-9
