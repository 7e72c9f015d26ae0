"""Sources, sinks, streams and the model hook."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from corpusprep.operators import enrich as K
from corpusprep.session import local_path
from corpusprep.sources import arrow_ipc, audio
from corpusprep.sources import sinks as S
from corpusprep.sources.scan import glob_scan, profile
from corpusprep.streaming import enrich_stream as L
from corpusprep.streaming import rate as RT


def test_arrow_ipc_roundtrip_one_partition_per_file(spark, tmp_dir):
    arrow_ipc.register(spark)
    df = spark.range(0, 30).select(F.col("id").alias("k"), F.format_string("t%d", "id").alias("t"))
    df.repartitionByRange(3, "k").write.format(arrow_ipc.FORMAT).mode("append").save(tmp_dir)
    back = spark.read.format(arrow_ipc.FORMAT).load(tmp_dir)
    assert back.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    files = sorted(os.listdir(local_path(tmp_dir)))
    assert len([f for f in files if f.endswith(".arrows")]) == 3


def test_wav_roundtrip_mono_and_stereo(spark, tmp_dir):
    x = (np.sin(np.arange(64) / 5) * 0.5).astype(np.float32)
    df = spark.createDataFrame([("m", x.tolist())], "name string, s array<float>")
    assert audio.write_wavs(df, f"{tmp_dir}/mono", "name", "s", 16000) == 1
    st = spark.createDataFrame([("s", np.repeat(x[:32], 2).tolist())], "name string, s array<float>")
    audio.write_wavs(st, f"{tmp_dir}/stereo", "name", "s", 44100, channels=2)
    m = audio.read_audio(spark, f"{tmp_dir}/mono/*.wav").first()["audio"]
    assert m["sampling_rate"] == 16000 and m["channels"] == 1
    assert np.allclose(m["array"], audio.pcm16(x) / 32768.0)
    s = audio.read_audio(spark, f"{tmp_dir}/stereo/*.wav").first()["audio"]
    assert s["sampling_rate"] == 44100 and s["channels"] == 2 and len(s["array"]) == 64


def test_glob_scan_reports_empty_glob(spark):
    with pytest.raises(ValueError, match="no parquet files"):
        glob_scan(spark, f"{SF001}/nothing_*.parquet")
    assert glob_scan(spark, f"{SF001}/doc*.parquet").count() == 200


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a")], "x long, y string")
    got = {r["column_name"]: (r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in profile(df, True).collect()}
    assert got == {"x": (3, 0, 2), "y": (3, 1, 1)}


def test_enrich_routes_errors_and_keeps_order(spark):
    class FlakyClient:  # local, so it is shipped to the workers by value
        def __call__(self, key, text):
            if key % 4 == 0:
                raise RuntimeError(f"boom {key}")
            return f"[startofspeech] {text} [endofspeech]"

    df = spark.createDataFrame([(i, f"text {i}!") for i in range(40)] + [(99, None)], "doc_id long, text string")
    out = K.enrich(df, client_factory=FlakyClient, max_in_flight=4).orderBy("doc_id").collect()
    assert out[0]["step1_text"] == "ERROR: boom 0"
    assert out[1]["step1_text"] == "startofspeechtext1endofspeech"   # stripped and F1-cleaned
    assert out[-1]["step1_text"] is None
    good, bad = K.error_split(K.enrich(df, client_factory=FlakyClient))
    assert bad.count() == 10 and good.count() == 31


def test_retry_backoff():
    calls, sleeps = [], []

    def fn(k, t):
        calls.append(k)
        if len(calls) < 3:
            raise ConnectionError("later")
        return "ok"

    assert K.RetryingCall(fn, attempts=3, sleep=sleeps.append)(1, "x") == "ok"
    assert len(calls) == 3 and sleeps == [4.0, 4.0]
    with pytest.raises(ConnectionError):
        K.RetryingCall(lambda k, t: (_ for _ in ()).throw(ConnectionError("x")), attempts=2,
                       sleep=lambda s: None)(1, "x")


def test_stream_enrich_restart_no_loss_no_repeat(spark, tmp_dir):
    src, base, ck = f"{tmp_dir}/src", f"{tmp_dir}/shards", f"{tmp_dir}/ck"
    rows = spark.range(0, 60).select(F.col("id").alias("doc_id"), F.format_string("doc %d", "id").alias("text"))
    for lo in (0, 20):
        rows.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 20)).coalesce(1).write.mode("append").parquet(src)
    L.run_to_end(L.stream_enrich(spark, L.source_stream(spark, src, rows.schema, 1), base, ck, "2024-01-01 00:00:00"))
    first = S.scan_shards(spark, base).count()
    rows.where(F.col("doc_id") >= 40).coalesce(1).write.mode("append").parquet(src)   # arrives after a stop
    L.run_to_end(L.stream_enrich(spark, L.source_stream(spark, src, rows.schema, 1), base, ck, "2024-01-01 00:00:00"))
    out = S.scan_shards(spark, base)
    assert first == 40 and out.count() == 60 and out.select("doc_id").distinct().count() == 60
    m = S.read_manifest(spark, base).orderBy("shard_id").collect()
    assert [r["shard_id"] for r in m] == [0, 1, 2] and sum(r["sample_count"] for r in m) == 60


def test_stream_rate_equals_batch_for_closed_windows(spark, tmp_dir):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, t0 + timedelta(minutes=7 * i), "a" if i % 2 else "b", float(i)) for i in range(80)],
                               "event_id long, ts timestamp_ntz, event_type string, value double")
    src, out, ck = f"{tmp_dir}/ev", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    for lo in range(0, 80, 20):
        ev.where((F.col("event_id") >= lo) & (F.col("event_id") < lo + 20)).coalesce(1).write.mode("append").parquet(src)
    s = RT.windowed_rates(L.source_stream(spark, src, ev.schema, 1), "ts", "event_type", "value",
                          "1 hour", "30 minutes", "1 hour")
    L.run_to_end(L.stream_to_parquet(s, out, ck))
    streamed = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(out).collect()}
    wm = t0 + timedelta(minutes=7 * 79) - timedelta(hours=1)
    batch = RT.windowed_rates(ev, "ts", "event_type", "value", "1 hour", "30 minutes", "1 hour")
    want = {(r["window_start"], r["event_type"]): r["n"] for r in batch.collect() if r["window_end"] <= wm}
    assert streamed == want and len(want) > 10


def test_publish_versions_increase(spark, tmp_dir):
    df = spark.range(0, 5)
    S.publish_version(df, tmp_dir, "train", "first")
    v = S.publish_version(df, tmp_dir, "train", "second").orderBy("version").collect()
    assert [(r["version"], r["message"], r["num_rows"]) for r in v] == [(1, "first", 5), (2, "second", 5)]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 200 and df.columns == ["doc_id", "prompt"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_corpus_scan_prunes_partitions(spark, tmp_dir):
    from corpusprep.sources.scan import scan_corpus
    df = spark.range(0, 40).select(F.col("id").alias("doc_id"),
                                   F.format_string("subset_%d", F.col("id") % 4).alias("subset"),
                                   F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    df.write.partitionBy("subset", "split").parquet(f"{tmp_dir}/corpus")
    got = scan_corpus(spark, f"{tmp_dir}/corpus", subset="subset_1", split="train")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subset" in plan and "subset_1" in plan
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(40) if i % 4 == 1 and i % 5]


def test_resume_point_with_gap(spark, tmp_dir):
    base = f"{tmp_dir}/gap"
    d = spark.range(0, 6).select(F.col("id").alias("k"),
                                 F.when(F.col("id") < 3, 0).otherwise(2).cast("int").alias("shard_id"))
    S.write_shards(d, base, "2024-01-01 00:00:00")
    rp = S.resume_point(spark, base).first()
    assert (rp["processed"], rp["last_shard_id"]) == (6, 2)   # next shard is 3, the gap stays


def test_stream_enrich_empty_source(spark, tmp_dir):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    src = f"{tmp_dir}/empty"
    os.makedirs(local_path(src), exist_ok=True)
    L.run_to_end(L.stream_enrich(spark, L.source_stream(spark, src, schema, 1), f"{tmp_dir}/shards",
                                 f"{tmp_dir}/ck", "2024-01-01 00:00:00"))
    out_schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shard_id", T.IntegerType())])
    assert S.scan_shards(spark, f"{tmp_dir}/shards", schema=out_schema).count() == 0
    assert S.resume_point(spark, f"{tmp_dir}/shards").first()["last_shard_id"] == -1


def test_write_numbered_files(spark, tmp_dir):
    df = spark.range(0, 10).select(F.col("id").alias("k"), F.format_string("text %d", "id").alias("text"), F.floor(F.col("id") / 4).cast("int").alias("shard_no"))
    for _ in range(2):   # a second run replaces the files of the first
        S.write_numbered(df, f"{tmp_dir}/num", "shard_no", 3)
    names = sorted(d for d in os.listdir(local_path(f"{tmp_dir}/num")) if not d.startswith("."))
    assert names == [f"train-0000{i}-of-00003.parquet" for i in range(3)]
    back = spark.read.parquet(f"{tmp_dir}/num/train*.parquet")
    assert sorted((r["k"], r["text"]) for r in back.collect()) == [(i, f"text {i}") for i in range(10)]
