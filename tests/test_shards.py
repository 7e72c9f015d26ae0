"""The shard writer's commit, versions published at the same time, descriptors of others."""

import glob
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corpusprep.session import local_path
from corpusprep.sources import sinks as S

TS = "2024-01-01 00:00:00"


def test_a_run_opens_no_file_of_earlier_runs(spark, tmp_dir):
    rows = spark.range(0, 90).select(F.col("id").alias("k"), F.array(F.lit(1), F.col("id")).alias("v"), (F.col("id") % 3).cast("int").alias("shard_id"))
    S.write_shards(rows.where("shard_id < 2").repartition(4), tmp_dir, TS)   # not clustered: a shard has parts of several tasks
    old = glob.glob(f"{local_path(tmp_dir)}/data/shard_id=0/part-*")
    assert len(old) > 1
    for f in old:
        with open(f, "wb") as out:
            out.write(b"not parquet")
    m = S.write_shards(rows.where("shard_id = 2"), tmp_dir, "2024-01-02 00:00:00")
    assert sorted(map(tuple, m.collect())) == [(0, 30, TS), (1, 30, TS), (2, 30, "2024-01-02 00:00:00")]
    # a run that replaces the shard takes its old files away
    S.write_shards(rows.where("shard_id = 0").limit(7), tmp_dir, TS)
    assert not any(os.path.exists(f) for f in old)
    got = S.scan_shards(spark, tmp_dir)
    assert set(got.columns) == {"k", "v", "shard_id"} and got.count() == 67 and got.select("k").distinct().count() == 67


def test_a_failed_run_certifies_nothing(spark, tmp_dir):
    rows = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") % 4).cast("int").alias("shard_id"))
    S.write_shards(rows, tmp_dir, TS)
    bad = rows.withColumn("k", F.when(F.col("shard_id") == 3, F.raise_error(F.lit("model away")).cast("long")).otherwise(-F.col("k")))
    with pytest.raises(Exception, match="model away"):
        S.write_shards(bad.repartition(4, "shard_id"), tmp_dir, TS)
    assert sorted(r.k for r in S.scan_shards(spark, tmp_dir).collect()) == list(range(40))
    with pytest.raises(Exception, match="without a shard"):
        S.write_shards(rows.withColumn("shard_id", F.lit(None).cast("int")), tmp_dir, TS)
    assert S.resume_point(spark, tmp_dir).first()["processed"] == 40
    assert S.write_shards(rows.where("false"), f"{tmp_dir}/none", TS).count() == 0


def test_publishers_at_the_same_time_get_different_versions(spark, tmp_dir):
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: S.publish_version(spark.range(i), tmp_dir, "train", f"m{i}"), range(6)))
    assert S._claim(spark, f"{tmp_dir}/_log/00000007.json") and not S._claim(spark, f"{tmp_dir}/_log/00000007.json")   # its publisher died
    last = S.publish_version(spark.range(9), tmp_dir, "test", None)
    got = {r.version: r for r in last.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 8] and got[8].message is None and got[8].split == "test"
    assert all(r.num_rows == int(r.message[1:]) for v, r in got.items() if v < 8)
    assert all(spark.read.parquet(f"{tmp_dir}/version={v}").count() == r.num_rows for v, r in got.items())


def test_descriptor_keeps_what_it_does_not_know(spark):
    df = spark.createDataFrame([("train", 0), ("train", 1), ("train", 1), ("new", 0), (None, 4)], "split string, shard int")
    was = {"license": None, "n": 1.5, "deep": {"splits": [1, {"num_bytes": 3}]}, "splits": {
        "train": {"num_bytes": 5, "shard_lengths": [1, 2], "num_shards": 9, "num_bytes_x": {"ü": [None]}}, "gone": {"num_shards": 3, "name": "gone"}}}
    got = json.loads(S.edit_descriptor(df, "split", "shard", json.dumps(was)).first()[0])
    assert got == {"license": None, "n": 1.5, "deep": was["deep"], "splits": {
        "train": {"num_shards": 2, "num_bytes_x": {"ü": [None]}}, "gone": {"num_shards": 0, "name": "gone"}, "new": {"num_shards": 1}}}
    assert json.loads(S.edit_descriptor(df, "split", "shard", '{"a": 1}').first()[0]) == {"a": 1, "splits": {"train": {"num_shards": 2}, "new": {"num_shards": 1}}}
    assert json.loads(S.edit_descriptor(df.where("false"), "split", "shard", "{}").first()[0]) == {"splits": {}}
    with pytest.raises(Exception):
        S.edit_descriptor(df, "split", "shard", "no json").collect()
