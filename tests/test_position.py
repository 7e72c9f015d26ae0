"""Positions, batches, shards, resume."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusprep.operators import position as D
from corpusprep.sources import sinks as S


def positions(df, **kw):
    return {r["k"]: r["pos"] for r in D.ordered_index(df, ["k"], **kw).collect()}


@pytest.mark.parametrize("parts", [1, 4, 32])
@pytest.mark.parametrize("buckets", [None, 7])
def test_ordered_index_is_row_number(spark, parts, buckets):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(parts)
    got = positions(df, n_buckets=buckets)
    assert got == {k: k for k in range(1000)}


def test_ordered_index_no_single_partition_exchange_over_rows(spark):
    """Only the per-bucket count table (<= n_buckets rows) meets a
    SinglePartition exchange (for its prefix sum); the rows never do."""
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    plan = D.ordered_index(df, ["k"], n_buckets=5)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1
    assert "HashAggregate(keys=[__cp_bucket" in lines[single[0] + 1]


def test_ordered_index_per_group_with_hot_group(spark):
    rows = [(0 if i % 3 else 1 + i % 5, i) for i in range(3000)]  # group 0 holds two thirds
    df = spark.createDataFrame(rows, "g long, k long")
    got = D.ordered_index(df, ["k"], partition_cols=["g"], n_buckets=16)
    w = Window.partitionBy("g").orderBy("k")
    ref = df.withColumn("want", F.row_number().over(w) - 1)
    bad = got.join(ref, ["g", "k"]).where(F.col("pos") != F.col("want")).count()
    assert bad == 0 and got.count() == 3000


def test_ordered_index_empty_and_one(spark):
    empty = spark.createDataFrame([], "k long")
    assert D.ordered_index(empty, ["k"]).count() == 0
    one = spark.createDataFrame([(5,)], "k long")
    assert positions(one) == {5: 0}


def test_batches_and_drop_last(spark):
    df = D.ordered_index(spark.range(0, 130).withColumnRenamed("id", "k"), ["k"])
    b = {r["k"]: r["batch_id"] for r in D.batch_assign(df, 64).collect()}
    assert b[63] == 0 and b[64] == 1 and b[129] == 2
    kept = D.batch_drop_last(df, 64, 130)
    assert kept.count() == 128
    for n in (63, 64, 65):
        d = D.ordered_index(spark.range(0, n).withColumnRenamed("id", "k"), ["k"])
        assert D.batch_drop_last(d, 64, n).count() == (n // 64) * 64


def test_shard_sizes_not_multiple(spark):
    assert D.rows_per_shard(100, 64) == 128
    assert D.rows_per_shard(128, 64) == 128
    df = D.ordered_index(spark.range(0, 300).withColumnRenamed("id", "k"), ["k"])
    counts = {r["shard_id"]: r["count"] for r in
              D.shard_assign(df, 100, 64).groupBy("shard_id").count().collect()}
    assert counts == {0: 128, 1: 128, 2: 44}


def test_resume_skip_and_cap(spark):
    assert D.skip_count(130, 64) == 192 and D.skip_count(0, 64) == 0 and D.skip_count(128, 64) == 128
    assert D.skip_count(130, 100) == 200   # batch size grew between runs: over-skips, as the reference does
    df = D.ordered_index(spark.range(0, 1000).withColumnRenamed("id", "k"), ["k"])
    rest = D.resume_skip(df, 130, 64)
    assert rest.agg(F.min("pos")).first()[0] == 192
    capped = D.sample_cap(rest, 130, 64, 500)
    # batches start at 130, 194, ..., 450 (< 500) then 514: six batches overshoot the cap
    assert capped.count() == 6 * 64


def test_epoch_shuffle_is_permutation_and_stable(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "k")
    a = {r["k"]: r["shuffle_pos"] for r in D.epoch_shuffle(df, "k", 7, 0).collect()}
    b = {r["k"]: r["shuffle_pos"] for r in D.epoch_shuffle(df.repartition(5), "k", 7, 0, n_buckets=4).collect()}
    c = {r["k"]: r["shuffle_pos"] for r in D.epoch_shuffle(df, "k", 7, 1).collect()}
    assert sorted(a.values()) == list(range(300)) and a == b and a != c


def test_row_peek_bounds(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "k")
    assert [r["k"] for r in D.row_peek(df, ["k"], 8).collect()] == [8, 9]
    with pytest.raises(IndexError):
        D.row_peek(df, ["k"], 10)


def test_resume_point_edges(spark, tmp_dir):
    rp = S.resume_point(spark, f"{tmp_dir}/missing").first()
    assert (rp["processed"], rp["last_shard_id"]) == (0, -1)
    base = f"{tmp_dir}/out"
    d = spark.range(0, 10).select(F.col("id").alias("k"), F.floor(F.col("id") / 4).cast("int").alias("shard_id"))
    S.write_shards(d, base, "2024-01-01 00:00:00")
    # a shard whose data landed but whose manifest did not: ignored
    spark.range(0, 3).select(F.col("id").alias("k"), F.lit(9).alias("shard_id")) \
        .write.mode("append").partitionBy("shard_id").parquet(f"{base}/data")
    rp = S.resume_point(spark, base).first()
    assert (rp["processed"], rp["last_shard_id"]) == (10, 2)
    assert S.scan_shards(spark, base).count() == 10
    m = {r["shard_id"]: r["sample_count"] for r in S.read_manifest(spark, base).collect()}
    assert m == {0: 4, 1: 4, 2: 2}


def test_ordered_index_sampled_boundaries(spark, monkeypatch):
    """Large-table path: boundaries from a sample still give exact positions."""
    monkeypatch.setattr(D, "SAMPLE_PER_BUCKET", 5)
    df = spark.range(0, 5000).select(((F.col("id") * 104729) % 5000).alias("k"))
    got = positions(df, n_buckets=20)
    assert got == {k: k for k in range(5000)}
