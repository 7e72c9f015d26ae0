"""T3-T11, G1-G9, C1, D11, D12 on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.operators import frames as G
from corpusprep.operators import tokens as TK


def test_truncate_eos_inside_and_outside(spark):
    L = 4
    df = spark.createDataFrame([(0, [5, 6, 7]), (1, [5, 6, 7, 8]), (2, [5, 6, 7, 8, 9]), (3, [])],
                               "i int, ids array<int>")
    r = df.select("i", A.truncate("ids", L, 0, True).alias("a"), A.truncate("ids", L, 0, False).alias("b"),
                  A.truncate("ids", L).alias("c")).orderBy("i").collect()
    assert [x["a"] for x in r] == [[5, 6, 7, 0], [5, 6, 7, 8], [5, 6, 7, 8], [0]]
    assert [x["b"] for x in r] == [[5, 6, 7, 0], [5, 6, 7, 8, 0], [5, 6, 7, 8, 0], [0]]
    assert [x["c"] for x in r] == [[5, 6, 7], [5, 6, 7, 8], [5, 6, 7, 8], []]


def test_pad_batch_and_labels(spark):
    df = spark.createDataFrame([(0, 0, [5, 6, 7]), (1, 0, [5]), (2, 0, []), (3, 1, [9])],
                               "i int, batch_id long, ids array<int>")
    r = TK.pad_batch(df).orderBy("i").collect()
    assert [x["labels"] for x in r] == [[5, 6, 7, 0], [5, 0, 0, 0], [0, 0, 0, 0], [9, 0]]
    assert [x["labels_mask"] for x in r] == [[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0], [1, 1]]
    lab = TK.pad_batch(df).select("i", A.label_ids(F.lit(2), "labels", "labels_mask").alias("l")).orderBy("i")
    got = [x["l"] for x in lab.collect()]
    # EOS kept, pads ignored, prefix ignored; an empty reply keeps only its EOS
    assert got[1] == [-100, -100, 5, 0, -100, -100] and got[2] == [-100, -100, 0, -100, -100, -100]
    left = TK.pad_left_batch(df).orderBy("i").collect()
    assert left[1]["input_ids"] == [0, 0, 5] and left[1]["input_mask"] == [0, 0, 1]


def test_chat_labels_only_assistant(spark):
    turns = spark.createDataFrame([(1, 0, "user", [3, 4]), (1, 1, "assistant", [5]), (1, 2, "user", [6])],
                                  "conv_id long, turn long, role string, ids array<int>")
    r = TK.chat_labels(turns).first()
    assert r["input_ids"] == [3, 4, 5, 6] and r["labels"] == [-100, -100, 5, -100] and r["piece_no"] == 0
    pieces = TK.chat_labels(turns, turns_per_piece=2).orderBy("piece_no").collect()
    assert [p["input_ids"] for p in pieces] == [[3, 4, 5], [6]]
    assert sum((p["labels"] for p in pieces), []) == [-100, -100, 5, -100]


def test_vocab_token_ids_roundtrip_both_plans(spark):
    docs = spark.createDataFrame([(0, "b a a\n c"), (1, "  a  b "), (2, ""), (3, None)], "doc_id long, text string")
    vocab = TK.build_vocab(docs, "text")
    v = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert v == {"a": 2, "b": 3, "c": 4}  # count desc, then token; after 2 specials
    for rows in (10, 1, 0):  # broadcast plan, hybrid head/tail plan, all-tail plan
        ids = {r["doc_id"]: r["ids"] for r in TK.token_ids(docs, vocab, "doc_id", broadcast_rows=rows).collect()}
        assert ids == {0: [3, 2, 2, 4], 1: [2, 3], 2: [], 3: []}
        back = TK.detokenise(TK.token_ids(docs, vocab, "doc_id"), vocab, "doc_id", broadcast_rows=rows)
        assert {r["doc_id"]: r["text"] for r in back.collect()} == {0: "b a a c", 1: "a b", 2: "", 3: ""}
    unk = spark.createDataFrame([(9, "a zzz c")], "doc_id long, text string")
    assert TK.token_ids(unk, vocab, "doc_id").first()["ids"] == [2, TK.UNK_ID, 4]
    assert TK.token_ids(unk, vocab, "doc_id", broadcast_rows=1).first()["ids"] == [2, TK.UNK_ID, 4]


def test_embedding_lookup_keeps_order(spark):
    table = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    ids = spark.createDataFrame([(7, [1, 0, 5])], "k long, ids array<int>")
    r = TK.embedding_lookup(ids, table, "k").orderBy("pos").collect()
    assert [x["vector"] for x in r] == [[1.0, 0.0], [0.0, 1.0], None]


@pytest.mark.parametrize("shape,want", [
    ([[1.0, 3.0], [5.0, 7.0], [2.0, 2.0]], [2.0, 6.0, 2.0]),          # [n, 2]
    ([[1.0, 2.0, 3.0], [3.0, 4.0, 5.0]], [2.0, 3.0, 4.0]),            # [2, n]
    ([[1.0, 3.0], [5.0, 7.0]], [2.0, 6.0]),                           # [2, 2] is frames x channels
])
def test_downmix_shapes(spark, shape, want):
    df = spark.createDataFrame([(shape,)], "a array<array<double>>")
    assert df.select(A.downmix("a").alias("m")).first()["m"] == want


def test_downmix_bad_shape_raises(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0]] * 3,)], "a array<array<double>>")
    with pytest.raises(Exception):
        df.select(A.downmix("a")).collect()


def test_resample_linear(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0], 16000), (1, [0.0, 1.0, 2.0, 3.0], 8000),
                                (2, [0.0, 2.0, 4.0, 6.0], 32000), (3, [5.0], 44100), (4, [], 44100)],
                               "i int, x array<double>, sr int")
    r = df.select("i", A.resample_linear("x", F.col("sr"), 16000).alias("y")).orderBy("i").collect()
    assert r[0]["y"] == [0.0, 1.0, 2.0, 3.0]                       # equal rates: unchanged
    assert r[1]["y"] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0]  # up: clamp at the end
    assert r[2]["y"] == [0.0, 4.0]                                 # down
    assert r[3]["y"] == [5.0] and r[4]["y"] == []


def test_segment_and_rejoin(spark):
    df = spark.createDataFrame([(0, "abcdefg"), (1, "abc"), (2, "abcdef"), (3, "")], "k long, t string")
    seg = G.segment_text(df, "k", "t", 3)
    got = {}
    for r in seg.collect():
        got.setdefault(r["k"], []).append((r["seg_no"], r["chunk"]))
    assert sorted(got[0]) == [(0, "abc"), (1, "def"), (2, "g")] and sorted(got[1]) == [(0, "abc")]
    assert 3 not in got
    back = {r["k"]: r["text"] for r in G.rejoin(seg, "k", sep="").collect()}
    assert back == {0: "abcdefg", 1: "abc", 2: "abcdef"}


def test_frame_stack_strict_and_drop_tail(spark):
    rows = [(1, i, [float(i), float(-i)]) for i in range(6)] + [(2, i, [float(i), 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "clip int, frame long, v array<double>")
    ok = G.frame_stack(df.where("clip = 2"), "clip", "frame", "v", 4).collect()
    assert ok[0]["stacked"] == [0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0]
    with pytest.raises(Exception):
        G.frame_stack(df, "clip", "frame", "v", 4).collect()
    kept = G.frame_stack(df, "clip", "frame", "v", 4, drop_tail=True)
    assert sorted((r["clip"], r["group_no"]) for r in kept.collect()) == [(1, 0), (2, 0)]


def test_mask_downsample_and_stride(spark):
    rows = [(1, i, m) for i, m in enumerate([0, 0, 0, 0, 0, 1, 0])] + [(2, i, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "clip int, frame long, mask int")
    got = {(r["clip"], r["group_no"]): r["mask"] for r in G.mask_downsample(df, "clip", "frame", "mask", 4).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 0): 0}
    assert sorted(r["frame"] for r in G.mask_stride(df.where("clip = 1"), "frame", 4).collect()) == [0, 4]


def test_mask_augment_deterministic(spark):
    df = spark.createDataFrame([(i, [1.0] * 32) for i in range(20)], "k long, x array<double>")
    spans = A.augment_spans("k", 3, 2, 8, F.size("x"))
    a = [r["y"] for r in df.select("k", A.apply_mask_spans("x", spans).alias("y")).orderBy("k").collect()]
    b = [r["y"] for r in df.repartition(3).select("k", A.apply_mask_spans("x", spans).alias("y")).orderBy("k").collect()]
    assert a == b and any(0.0 in y for y in a) and all(len(y) == 32 for y in a)


def test_project_vectors_matches_numpy(spark):
    w = G.projector_weights(4, 3, hidden=8, seed=1)
    x = np.arange(12, dtype=np.float32).reshape(3, 4) / 10
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "k long, v array<float>")
    got = np.array([r["projected"] for r in G.project_vectors(df, "v", w).orderBy("k").collect()])
    want = np.maximum(x @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
    assert np.allclose(got, want, atol=1e-5)


def test_detokenise_hybrid_matches_broadcast(spark):
    docs = spark.createDataFrame([(0, "b a a\n c d"), (1, "  a  b e"), (2, "")], "doc_id long, text string")
    vocab = TK.build_vocab(docs, "text")
    ids = TK.token_ids(docs, vocab, "doc_id")
    want = {r["doc_id"]: r["text"] for r in TK.detokenise(ids, vocab, "doc_id").collect()}
    for rows in (2, 0):
        got = {r["doc_id"]: r["text"] for r in TK.detokenise(ids, vocab, "doc_id", broadcast_rows=rows).collect()}
        assert got == want == {0: "b a a c d", 1: "a b e", 2: ""}


def test_spec_augment_masks_time_and_frequency(spark):
    rows = [(c, t, [1.0] * 32) for c in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "clip int, frame long, v array<double>")
    out = G.spec_augment(df, "clip", "frame", "v", seed=1, n_time_masks=3, time_mask_param=10,
                         n_freq_masks=2, freq_mask_param=6, p=0.5).collect()
    by_clip = {}
    for r in out:
        by_clip.setdefault(r["clip"], []).append(r["features"])
    for feats in by_clip.values():
        zero_frames = sum(1 for f in feats if all(x == 0.0 for x in f))
        kept = [f for f in feats if not all(x == 0.0 for x in f)]
        zero_bins = {i for i in range(32) if all(f[i] == 0.0 for f in kept)}
        assert zero_frames <= 3 * 9                       # widths < time_mask_param
        assert all({i for i, x in enumerate(f) if x == 0.0} == zero_bins for f in kept)   # same bins per clip
        assert len(zero_bins) <= 2 * 5
    again = G.spec_augment(df.repartition(4), "clip", "frame", "v", seed=1, n_time_masks=3, time_mask_param=10,
                           n_freq_masks=2, freq_mask_param=6, p=0.5)
    assert sorted((r["clip"], r["frame"], tuple(r["features"])) for r in again.collect()) == \
        sorted((r["clip"], r["frame"], tuple(r["features"])) for r in out)


def test_head_of_a_vocabulary_is_cut_without_a_sort(spark):
    rows = [(f"t{i}", 10_000 // (i + 1), i) for i in range(1000)] + [("x" * 100, 9, 2000)]
    for cols in ("token string, count long, token_id long", "token string, token_id long"):
        v = spark.createDataFrame([r if "count" in cols else (r[0], r[2]) for r in rows], cols).repartition(8)
        h = TK._head(v, 100)
        plan = h._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Limit" not in plan
        ids = {r.token_id for r in h.collect()}
        assert ids == set(range(len(ids))) and 60 <= len(ids) <= 100
    assert TK._head(v, 5000).count() == 1000
    assert TK.BROADCAST_BYTES <= 64 << 20


def test_batches_to_python_are_bounded(spark):
    from corpusprep.plans.catalog import REGISTRY
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    REGISTRY["span_split"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
