"""Shards as folders with Arrow files and a metadata file each."""

import glob
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusprep.session import local_path
from corpusprep.sources import shard_dirs as S

TS = "2024-01-01 00:00:00"


def rows(spark, n=90, shards=3):
    return spark.range(n).select(F.col("id").alias("k"), F.array(F.lit(1.5), F.col("id")).alias("v"), F.when(F.col("id") % 2 == 0, F.lit("e")).alias("t"),
                                 (F.col("id") % shards).cast("int").alias("shard_id"))


def test_round_trip_pruning_and_resume(spark, tmp_dir):
    assert S.resume_point_of_dirs(spark, tmp_dir).first() == (0, -1)
    df = rows(spark)
    assert S.read_shard_dirs(spark, tmp_dir, df.schema).count() == 0
    with pytest.raises(Exception, match="no shards"):
        S.read_shard_dirs(spark, tmp_dir)
    S.write_shard_dirs(df.where("shard_id < 2").repartition(4), tmp_dir, TS)   # not clustered: files of several tasks
    S.write_shard_dirs(df.where("shard_id = 2").repartition(1), tmp_dir, TS)
    root = local_path(tmp_dir)
    assert len(glob.glob(f"{root}/shard_00000000/data-*.arrow")) == 4 and os.listdir(f"{root}/shard_00000002") != []
    assert json.load(open(f"{root}/shard_00000002/metadata.json")) == {"shard_id": 2, "sample_count": 30, "timestamp": TS}
    # a shard of another writer, and one without metadata
    for shard in (7, 9):
        os.makedirs(f"{root}/shard_{shard:08d}")
        with pa.OSFile(f"{root}/shard_{shard:08d}/data-00000-of-00001.arrow", "wb") as f, pa.ipc.new_stream(f, pa.schema([("t", pa.string()), ("k", pa.int64()), ("v", pa.list_(pa.float64()))])) as w:
            w.write_table(pa.table({"t": ["x"], "k": pa.array([1000 + shard], pa.int64()), "v": [[1.0]]}))
    json.dump({"shard_id": 7, "sample_count": 1, "timestamp": TS, "more": None}, open(f"{root}/shard_00000007/metadata.json", "w"))
    got = S.read_shard_dirs(spark, tmp_dir)
    assert got.columns == ["k", "v", "t", "shard_id"]
    key = lambda r: r.k
    assert sorted(got.collect(), key=key) == sorted(df.collect(), key=key) + [(1007, [1.0], "x", 7)]
    assert S.resume_point_of_dirs(spark, tmp_dir).first() == (91, 7)
    # no file of a shard outside the condition is opened, its metadata neither
    for name in [*glob.glob(f"{root}/shard_00000001/*"), f"{root}/shard_00000007/metadata.json"]:
        with open(name, "wb") as f:
            f.write(b"not what it was")
    for condition, shards in (("shard_id = 2", {2}), ("shard_id in (0, 2, 5)", {0, 2}), ("shard_id >= 2 and shard_id < 7", {2}), ("shard_id < 1 and k > 50", {0}), ("shard_id > 90", set())):
        assert {r.shard_id for r in got.where(condition).collect()} == shards, condition
    parts = spark.read.format(S.FORMAT).option("rowsPerPartition", 40).load(tmp_dir).where("shard_id in (0, 2)")
    assert parts.rdd.getNumPartitions() == 2 and got.where("shard_id in (0, 2)").rdd.getNumPartitions() == 1


def test_replaced_failed_and_damaged_shards(spark, tmp_dir):
    df = rows(spark, 40, 4)
    S.write_shard_dirs(df.repartition(4, "shard_id"), tmp_dir, TS)
    bad = df.withColumn("k", F.when(F.col("shard_id") == 3, F.raise_error(F.lit("model away")).cast("long")).otherwise(-F.col("k")))
    with pytest.raises(Exception, match="model away"):
        S.write_shard_dirs(bad.repartition(4, "shard_id"), tmp_dir, TS)
    with pytest.raises(Exception, match="without a shard"):
        S.write_shard_dirs(df.withColumn("shard_id", F.lit(None).cast("int")), tmp_dir, TS)
    assert sorted(r.k for r in S.read_shard_dirs(spark, tmp_dir).collect()) == list(range(40))
    S.write_shard_dirs(df.where("k = 4"), tmp_dir, "2024-01-02 00:00:00")
    assert sorted(r.k for r in S.read_shard_dirs(spark, tmp_dir).where("shard_id = 0").collect()) == [4]
    assert S.resume_point_of_dirs(spark, tmp_dir).first() == (31, 3)
    os.remove(glob.glob(f"{local_path(tmp_dir)}/shard_00000002/data-*")[0])
    with pytest.raises(Exception, match="holds 0 rows, its metadata says 10"):
        S.read_shard_dirs(spark, tmp_dir).collect()
