"""F17/F18 and D7-D10 against brute force; H1-H3, C5; E5 against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusprep.functions import maps as M
from corpusprep.functions.edit import with_word_distance
from corpusprep.operators import metrics as R
from corpusprep.streaming import rate as RT


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_char_and_word_distance_brute_force(spark):
    rnd = random.Random(11)
    words = ["a", "bb", "été", "猫", "x", "ÿy", "the", "of"]
    pairs = [("same words", "same words"), ("one", ""), ("", "x y"), ("naïve café", "naive cafe"), ("w", "w")]
    for _ in range(200):
        pairs.append((" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))),
                      " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))))
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, reference string, hypothesis string")
    got = R.score_pairs(df).orderBy("i").collect()
    for row, (r, h) in zip(got, pairs):
        assert row["char_edits"] == lev(r, h)
        assert row["word_edits"] == lev(r.split(), h.split())
        assert (row["cer"] is None) == (len(r) == 0)


def test_word_distance_many_distinct_words(spark):
    ref = " ".join(f"w{i}" for i in range(40000))            # beyond the BMP stand-ins
    hyp = " ".join(f"w{i}" for i in range(40000) if i % 1000)
    df = spark.createDataFrame([(ref, hyp)], "reference string, hypothesis string")
    got = with_word_distance(df, F.col("reference"), F.col("hypothesis")).first()["word_edits"]
    assert got == 40


def test_micro_macro_rollups(spark):
    pairs = [("abcd", "abce"), ("ab", "ab"), ("", "zzz"), ("a b c", "a c")]
    df = spark.createDataFrame(pairs, "reference string, hypothesis string")
    s = R.score_pairs(df)
    macro = R.cer_macro(s).first()
    assert abs(macro["cer_macro"] - (0.25 + 0 + 2 / 5) / 3) < 1e-12 and macro["n_pairs"] == 3
    assert abs(R.cer_micro(s).first()["cer_micro"] - (1 + 0 + 2) / (4 + 2 + 5)) < 1e-12
    assert abs(R.wer_micro(s).first()["wer_micro"] - (1 + 0 + 1) / (1 + 1 + 3)) < 1e-12
    pts = spark.createDataFrame([("loss", 0, 1.0), ("loss", 0, 3.0), ("loss", 1, 5.0)], "name string, batch long, value double")
    r = R.metric_rollup(pts, "name", "batch", "value").first()
    assert r["mean_of_batch_means"] == 3.5 and r["weighted_mean"] == 3.0 and r["n_batches"] == 2


def test_topk_ties(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(10)], "g string, id long, v double")
    got = [(r["id"], r["rank"]) for r in R.topk(df, ["g"], ["v", "id"], 3).orderBy("rank").collect()]
    assert got == [(0, 1), (3, 2), (6, 3)]


def test_map_prefix_functions(spark):
    df = spark.createDataFrame([({"projector.projector.w": 1.0, "projector.": 2.0, "speech_encoder.x": 3.0,
                                  "llm_model": 4.0, "soft_prompt_embeddings.e": 5.0},), ({},)],
                               "m map<string,double>")
    rows = df.select(M.drop_prefixes("m").alias("d"), M.strip_prefix("m").alias("s")).collect()
    assert rows[0]["d"] == {"projector.projector.w": 1.0, "projector.": 2.0, "soft_prompt_embeddings.e": 5.0}
    assert rows[0]["s"] == {"w": 1.0, "": 2.0}      # every occurrence goes; the bare prefix becomes ""
    assert rows[1]["d"] == {} and rows[1]["s"] == {}
    upd = df.select(M.update_known(F.create_map(F.lit("w"), F.lit(0.0), F.lit("z"), F.lit(9.0)),
                                   M.strip_prefix("m")).alias("u")).first()["u"]
    assert upd == {"z": 9.0, "w": 1.0}


def brute_rate(rows, W, mx):
    out = {}
    for eid, user, ts in rows:
        prior = [t for e, u, t in rows if u == user and (t < ts or (t == ts and e < eid)) and (ts - t) < W]
        wait = (min(prior) + W - ts) if len(prior) >= mx else 0
        out[eid] = (len(prior), len(prior) >= mx, wait)
    return out


def test_rate_audit_brute_force_with_hot_caller(spark):
    rnd = random.Random(2)
    t0 = datetime(2024, 1, 1)
    W = 600 * 1_000_000  # 10 minutes
    rows = []
    for e in range(600):
        user = 0 if e % 3 == 0 else rnd.randint(1, 9)   # user 0 holds a third
        us = rnd.randint(0, 4 * 3600) * 1_000_000
        rows.append((e, user, us))
    rows.append((600, 5, rows[10][2] + W))            # exactly W after another request: not counted
    rows.append((601, rows[10][1], rows[10][2]))      # equal timestamp
    df = spark.createDataFrame([(e, u, t0 + timedelta(microseconds=t)) for e, u, t in rows],
                               "event_id long, user_id long, ts timestamp_ntz")
    want = brute_rate(rows, W, 3)
    for bucket in (None, W // 3, W // 7):   # finer buckets split a flooding caller
        got = {r["event_id"]: (r["prior_requests"], r["at_limit"], r["wait_us"])
               for r in RT.rate_audit(df, "user_id", "ts", "event_id", W, 3, bucket_us=bucket).collect()}
        assert got == want
