import random

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import maps as M
from corpusprep.operators import batches as BT
from corpusprep.operators import metrics as R
from corpusprep.operators import position as D
from corpusprep.operators import tokens as TK
from corpusprep.session import materialize, spread


def brute(rows, clips, assistant, soft, stack, shifted):
    """The collator's arithmetic, batch by batch, on lists."""
    out = {}
    rows = [(k, b, p or [], r or [], clips[k] or []) for k, b, p, r in rows if k in clips]
    for k, b, p, r, f in rows:
        mine = [x for x in rows if x[1] == b]
        mp, mf, mr = (max(len(x[i]) for x in mine) for i in (2, 4, 3))
        ids = r + [0] + [0] * (mr - len(r))
        real = [1] * (len(r) + 1) + [0] * (mr - len(r))
        at = [0, mp, mp + soft, mp + soft + mf // stack, mp + soft + mf // stack + len(assistant)]
        mask = [1] * len(p) + [0] * (mp - len(p)) + [1] * (at[4] - mp) + (real[:-1] if shifted else real)
        target = [i if m else -100 for i, m in zip(ids, real)]
        labels = [-100] * at[4] + (target[1:] if shifted else target)
        out[k] = {"audio_features": f + [0.0] * (mf - len(f)), "audio_masks": [1] * len(f) + [0] * (mf - len(f)), "input_ids": p + [0] * (mp - len(p)),
                  "output_ids": ids, "output_masks": real, "attention_mask": mask, "labels": labels, "offsets": [*at, len(mask)]}
        assert len(mask) == len(labels)
    return out


@pytest.mark.parametrize("shifted", [False, True])
@pytest.mark.parametrize("assistant,soft,stack", [((7, 8), 3, 4), ((), 0, 1)])
def test_train_batch(spark, shifted, assistant, soft, stack):
    r = random.Random(soft)
    rows = [(k, k // 4, [r.randrange(2, 99) for _ in range(r.randrange(9))], [r.randrange(2, 99) for _ in range(r.randrange(12))]) for k in range(40)]
    rows += [(100, 50, None, None), (101, 50, [5], []), (102, 51, [], [3, 4]), (103, 52, [1], [2])]  # 103 has no clip
    clips = {k: [float(i) for i in range(r.randrange(20))] for k, *_ in rows if k != 103} | {101: None, 102: [], 999: [1.0]}
    text = spark.createDataFrame(rows, "k long, batch_id long, prompt_ids array<int>, reply_ids array<int>")
    audio = spark.createDataFrame(list(clips.items()), "k long, features array<float>")
    d = BT.train_batch(text, audio, "k", assistant_ids=assistant, soft_len=soft, stack=stack, shifted=shifted).withColumn("offsets", BT.offset_list())
    got = {x.k: x.asDict() for x in d.collect()}
    want = brute(rows, clips, list(assistant), soft, stack, shifted)
    assert got.keys() == want.keys() and 103 not in got and 999 not in got
    for k, w in want.items():
        assert {c: got[k][c] for c in w} == w
        assert got[k]["assistant_token_ids"] == list(assistant)
        # a label stands where its id stands in the sequence (one place earlier in the shifted form)
        at = w["offsets"][4]
        assert [x for x in w["labels"] if x != -100] == [i for i, m in zip(w["output_ids"], w["output_masks"]) if m][shifted:]
        assert all(x == -100 for x in w["labels"][:at])


def test_train_batch_of_nothing(spark):
    text = spark.createDataFrame([], "k long, batch_id long, prompt_ids array<int>, reply_ids array<int>")
    assert BT.train_batch(text, spark.createDataFrame([], "k long, features array<float>"), "k").count() == 0


def test_special_tokens_are_rows_and_render(spark):
    texts = [(1, "a<|endoftext|>b a"), (2, "<|endoftext|><|endoftext|>"), (3, None), (4, "endoftext <|endof text|> <unk>x"), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    vocab = TK.build_vocab(df, special_rows=True)
    rows = {r.token: (r.token_id, r["count"]) for r in vocab.collect()}
    assert rows["<|endoftext|>"] == (0, 3) and rows["<unk>"] == (1, 1) and rows["a"] == (2, 2)
    assert sorted(i for i, _ in rows.values()) == list(range(len(rows)))
    ids = TK.token_ids(TK.special_texts(df), vocab, "doc_id")
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[1] == [2, 0, rows["b"][0], 2] and got[2] == [0, 0] and got[3] == [] == got[5] and got[4][-2:] == [1, rows["x"][0]]
    whole = {r.doc_id: r.text for r in TK.detokenise(ids, vocab, "doc_id", skip_ids=()).collect()}
    assert whole == {1: "a <|endoftext|> b a", 2: "<|endoftext|> <|endoftext|>", 3: "", 4: "endoftext <|endof text|> <unk> x", 5: ""}
    assert {r.doc_id: r.text for r in TK.detokenise(ids, vocab, "doc_id").collect()}[1] == "a b a"
    none = {r.token: (r.token_id, r["count"]) for r in TK.build_vocab(spark.createDataFrame([(1, "x")], "doc_id long, text string"), special_rows=True).collect()}
    assert none == {"<|endoftext|>": (0, 0), "<unk>": (1, 0), "x": (2, 1)}


def test_strip_prefix_when_keys_meet(spark):
    rows = [({"projector.a": 1, "projector.projector.a": 2, "b": 9, "projector.c": 3},), ({"projector.a": 1, "projector.b": None},), ({},), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "m map<string,int>").select(M.strip_prefix("m").alias("m")).collect()]
    assert got == [{"a": 2, "c": 3}, {"a": 1, "b": None}, {}, None]


def test_composite_order_spreads_a_hot_first_key(spark):
    """Three quarters of all rows on one first key: no task holds them, and the positions are right."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 50).alias("a"), F.xxhash64("id").alias("b"))
    tasks = []
    write = D.materialize

    def seen(df, name):
        out = write(df, name)
        tasks.extend(r["count"] for r in out.groupBy(D._BUCKET).count().collect())
        return out

    D.materialize = seen
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows together again
    try:
        got = [(r.a, r.b) for r in D.ordered_index(rows, ["a", "b"]).orderBy("pos").collect()]
    finally:
        D.materialize = write
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted((r.a, r.b) for r in rows.collect())
    assert max(tasks) < 40_000 * .4
    # a stand-in that is equal for all rows of a large table
    same = D.ordered_index(rows, ["b"], proxy=F.lit(1.0), rows_per_bucket=1000)
    assert [r.b for r in same.orderBy("pos").collect()] == sorted(r.b for r in rows.collect())


def test_rows_of_a_join_are_dealt_out(spark):
    """The optimizer's estimate of a join is the product of its sides; the pairs must be scored by all cores all the same."""
    t = materialize(spark.range(3000).select((F.col("id") % 50).alias("conv_id"), F.floor(F.col("id") / 50).alias("turn"), F.lit("some words here").alias("text")), "turns")
    pairs = R.pair_turns(t)
    assert int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 100 * 3000
    assert spread(pairs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
