"""The pipeline on planted documents, stage by stage, and its edge rows."""

import random

import corpus_pipeline as P
from corpusprep.llm import simhash_tiles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r string, score double"


def sentence(r, n):
    return " ".join("w%d" % r.randrange(5000) for _ in range(n)) + "."


def clean(r):
    return "\n".join(sentence(r, r.randint(15, 40)) for _ in range(6))


def planted():
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        t = clean(r)
        toxic = i % 8 == 0
        if toxic:
            t += " you utter grobian."
        rows.append((i, t))
        labels.append((i, int(toxic)))
    passage = sentence(r, 70)
    base = clean(r)
    words = base.split(" ")
    near = " ".join(words[:3] + ["changed"] + words[4:])
    rows += [(1000, clean(r) + "\n" + passage), (1001, clean(r) + "\n" + passage), (1002, base), (1003, base), (1004, near), (1005, "too short."),
             (1006, None), (1007, ""), (1008, "\n".join("Home | News | Sport | Weather | More" for _ in range(40))), (1002, base), (None, clean(r))]
    return [(i, t, "en", "s", len(t or ""), "own", 1.5) for i, t in rows], labels, passage


def test_stages_and_run(spark, tmp_dir):
    rows, labels, passage = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_dir}/documents.parquet"), {}
    for name, stage in P.STAGES:
        d = P.materialize(stage(spark, d, tmp_dir), "stage")
        seen[name] = d.collect()
        if name != "packing":
            assert d.columns == docs.columns
            assert all(x.n_chars == len(x.text or "") and x.r == "own" and x.score == 1.5 for x in seen[name])
    ids = {n: [x.doc_id for x in v] for n, v in seen.items()}
    assert sorted(x for x in ids["toxicity"] if x is not None and x < 400) == [i for i in range(400) if i % 8]
    assert len(ids["toxicity"]) == 350 + 11
    gone = {1005, 1006, 1007, 1008}
    assert sorted(ids["quality rules"], key=str) == sorted([x for x in ids["toxicity"] if x not in gone], key=str)
    assert sorted(ids["line dedup"], key=str) == sorted(ids["quality rules"], key=str)
    text = {}
    for x in seen["line dedup"]:
        text.setdefault(x.doc_id, []).append(x.text)
    assert passage in text[1000][0] and passage not in text[1001][0]
    assert text[1002] == [text[1002][0]] * 2 and text[1003] == [""] and len(text[1004][0]) < len(text[1002][0])
    before = {x.doc_id: x.text for x in seen["quality rules"]}
    assert all(text[i][0] == before[i] for i in range(400) if i % 8)
    # one row of each group, that of the least id; brute force over all pairs
    rest = [x for x in seen["line dedup"]]
    fp = [simhash_tiles.fingerprint((x.text or "").encode()) for x in rest]
    kept = []
    for k in sorted(range(len(rest)), key=lambda k: (rest[k].doc_id is None, rest[k].doc_id or 0)):
        if all(bin(fp[k] ^ fp[j]).count("1") > 2 for j in kept):
            kept.append(k)
    assert sorted((rest[k].doc_id for k in kept), key=str) == sorted(ids["near duplicates"], key=str)
    assert {x.doc_id for x in seen["packing"]} == set(ids["near duplicates"])
    whole = P.run(spark, tmp_dir)
    assert sorted((str(x.doc_id), x.piece, x.length, x.ids_crc32) for x in whole.collect()) == \
        sorted((str(x.doc_id), x.piece, x.length, x.ids_crc32) for x in seen["packing"])


def test_empty_table(spark, tmp_dir):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    assert P.run(spark, tmp_dir).count() == 0
