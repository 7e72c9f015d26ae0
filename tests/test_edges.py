"""Rows that the given tables lack: null groups, empty texts, repeated keys,
left-over shards, odd clips, URIs."""

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions import maps as M
from corpusprep.operators import frames as G
from corpusprep.operators import position as D
from corpusprep.operators import tokens as TK
from corpusprep.session import spread
from corpusprep.sources import arrow_ipc
from corpusprep.sources import sinks as S


def test_null_groups_keep_their_rows(spark):
    d = spark.range(0, 300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    for buckets in (1, 16):
        got = D.ordered_index(d, ["id"], "g", n_buckets=buckets).collect()
        assert len(got) == 300
        for g in (None, 1, 2):
            assert [r.pos for r in sorted((r for r in got if r.g == g), key=lambda r: r.id)] == list(range(100))


def test_text_keys_have_positions(spark):
    rows = [("https://example.org/%06d" % (i * 7919 % 20_000),) for i in range(20_000)] + [(None,)]
    got = D.ordered_index(spark.createDataFrame(rows, "k string").repartition(6), ["k"]).collect()
    order = [r.k for r in sorted(got, key=lambda r: r.pos)]
    assert order == [None] + sorted(k for k, in rows if k) and sorted(r.pos for r in got) == list(range(20_001))


def test_empty_texts_are_rejoined(spark):
    d = spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, None)], "k int, t string")
    out = G.with_empty(G.rejoin(G.segment_text(d, "k", "t", 3), "k", sep=" "), d, "k", "t")
    assert sorted((r.k, r.text) for r in out.collect()) == [(1, "abc def gh"), (2, ""), (3, "")]


def test_token_plans_agree(spark):
    rows = [(1, "a b c a"), (1, "c d"), (None, "a zz"), (None, "b"), (2, None), (3, ""), (1, "c d")]
    d = spark.createDataFrame(rows, "k int, text string")
    vocab = TK.build_vocab(spark.createDataFrame([("a a a b b c d",)], "text string"))
    key = lambda r: (r.k is None, r.k or 0, r.ids)
    wide = sorted(TK.token_ids(d, vocab, "k").collect(), key=key)
    narrow = sorted(TK.token_ids(d, vocab, "k", broadcast_rows=1).collect(), key=key)
    assert [(r.k, r.ids) for r in wide] == [(r.k, r.ids) for r in narrow] and len(wide) == len(rows)
    ids = TK.token_ids(d, vocab, "k")
    key = lambda r: (r.k is None, r.k or 0, r.text)
    a = sorted(TK.detokenise(ids, vocab, "k").collect(), key=key)
    b = sorted(TK.detokenise(ids, vocab, "k", broadcast_rows=1).collect(), key=key)
    assert a == b and len(a) == len(rows)


def test_left_over_shards_stay_ignored(spark, tmp_dir):
    base = f"{tmp_dir}/shards"
    rows = spark.range(0, 5).select(F.col("id").alias("k"))
    # a run that broke off between its data and its manifest
    rows.withColumn(S.RUN, F.lit("lost")).withColumn("shard_id", F.lit(7)).write.partitionBy("shard_id").parquet(f"{base}/data")
    assert tuple(S.resume_point(spark, base).first()) == (0, -1)
    S.write_shards(rows.limit(2).withColumn("shard_id", F.lit(0)), base, "2024-01-01 00:00:00")
    S.write_shards(rows.limit(3).withColumn("shard_id", F.lit(1)), base, "2025-01-01 00:00:00")
    assert tuple(S.resume_point(spark, base).first()) == (5, 1)
    assert {r.shard_id: r.timestamp[:4] for r in S.read_manifest(spark, base).collect()} == {0: "2024", 1: "2025"}
    assert sorted(r.shard_id for r in S.scan_shards(spark, base).collect()) == [0, 0, 1, 1, 1]
    S.write_shards(rows.withColumn("shard_id", F.lit(7)), base, "2025-01-01 00:00:00")
    assert tuple(S.resume_point(spark, base).first()) == (10, 7)
    S.write_shards(rows.where("false").withColumn("shard_id", F.lit(9)), f"{tmp_dir}/none", "2025-01-01 00:00:00")
    assert tuple(S.resume_point(spark, f"{tmp_dir}/none").first()) == (0, -1)


def test_spread_runs_nothing(spark):
    d = spark.range(0, 1000).repartition(3).groupBy((F.col("id") % 7).alias("g")).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    out = spread(d)
    assert list(tracker.getJobIdsForGroup("spread")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 7


def test_interleaved_clips(spark):
    d = spark.createDataFrame([([],), ([1.0, 3.0],)], "v array<double>")
    assert [r.m for r in d.select(A.downmix(A.interleaved_to_frames("v")).alias("m")).collect()] == [[], [2.0]]
    odd = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(Exception, match="odd number of samples"):
        odd.select(A.interleaved_to_frames("v")).collect()


def test_strip_prefix_last_key_stays(spark):
    d = spark.sql("select map('projector.a', 1, 'projector.projector.a', 2, 'x', 3) as m")
    assert d.select(M.strip_prefix("m").alias("m")).first().m == {"a": 2}


def test_null_vector_is_projected_to_null(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, v array<double>")
    out = {r.k: r.projected for r in G.project_vectors(d, "v", G.projector_weights(2, 3, 4)).collect()}
    assert out[2] is None and len(out[1]) == 3


def test_arrow_files_by_uri_and_overwrite(spark, tmp_dir):
    arrow_ipc.register(spark)
    out = "file://" + f"{tmp_dir}/ipc".removeprefix("file:")
    d = spark.range(0, 10)
    for _ in range(2):
        d.write.format(arrow_ipc.FORMAT).mode("overwrite").save(out)
    assert spark.read.format(arrow_ipc.FORMAT).load(out).count() == 10
    d.write.format(arrow_ipc.FORMAT).mode("append").save(out)
    assert spark.read.format(arrow_ipc.FORMAT).load(out).count() == 20


def test_schema_enforcement_tells_why(spark):
    from corpusprep.operators import records as J
    rows = [(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1}'), (3, '{"a": "q"}'), (4, "{broken"), (5, None)]
    d = spark.createDataFrame(rows, "k int, j string")
    good, bad = J.accepted_and_rejected(d, "j", "a INT, b STRING")
    assert [(r.k, r.record.a, r.record.b) for r in good.collect()] == [(1, 1, "x")]
    assert {r.k: r.problem for r in bad.collect()} == {2: "missing: b", 3: "missing: a, b", 4: "malformed", 5: "malformed"}
