"""Sinks A7-A11: sharded output with a manifest, resume point, shard scan,
numbered files, dataset descriptor, versioned publishing.

A shard's manifest row is written only after its data is committed, and
readers only trust shards that have one - the same contract as the
reference's ``metadata.json``, but as tables.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions.text import numbered_file
from corpusprep.session import local_path
from corpusprep.sources import shard_writer

MANIFEST_SCHEMA = T.StructType([
    T.StructField("shard_id", T.IntegerType(), False),
    T.StructField("sample_count", T.LongType(), False),
    T.StructField("timestamp", T.StringType(), False),
])
RUN = shard_writer.TOKEN
STAMP = "%Y-%m-%d %H:%M:%S"   # as functions.text.TS_FORMAT
VERSION_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType(), False),
    T.StructField("split", T.StringType(), False),
    T.StructField("num_rows", T.LongType(), False),
    T.StructField("message", T.StringType(), True),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_shards(df: DataFrame, base: str, run_ts: str, shard_col: str = "shard_id") -> DataFrame:
    """Data under ``base/data/shard_id=<n>``, each shard replacing what an earlier run wrote for it, then one
    manifest file with the row counts that the tasks report (``shard_writer``). Nothing is read back, so the (possibly expensive)
    rows are computed once and a run costs the same however many came before.

    Only rows whose token the latest manifest row of their shard holds are certified, so what a crashed run or a failed
    attempt left behind stays ignored, whatever is written later, and the rows of older runs keep their timestamps."""
    spark = df.sparkSession
    shard_writer.register(spark)
    (df.sortWithinPartitions(shard_col).write.format(shard_writer.FORMAT).mode("append")
       .option("shard", shard_col).option("stamp", datetime.fromisoformat(run_ts).strftime(STAMP)).save(base))
    return read_manifest(spark, base)


def _latest(spark: SparkSession, base: str) -> DataFrame:
    """The last manifest row of each shard, with the tokens of the attempts that wrote it."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MANIFEST_SCHEMA)
    m = spark.read.schema(f"{fields}, {RUN} array<string>, written bigint").parquet(f"{base}/manifest")
    last = F.max_by(F.struct("sample_count", "timestamp", RUN), F.struct("written", RUN))
    return m.groupBy("shard_id").agg(last.alias("m")).select("shard_id", "m.*")


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    if not _exists(spark, f"{base}/manifest"):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return _latest(spark, base).drop(RUN)


def resume_point(spark: SparkSession, base: str) -> DataFrame:
    """``(processed rows, last shard id)``; ``(0, -1)`` when nothing is
    there; shards without a manifest row are ignored."""
    m = read_manifest(spark, base)
    return m.agg(F.coalesce(F.sum("sample_count"), F.lit(0)).cast("long").alias("processed"),
                 F.coalesce(F.max("shard_id"), F.lit(-1)).cast("int").alias("last_shard_id"))


def scan_shards(spark: SparkSession, base: str, with_provenance: bool = False,
                schema: T.StructType | None = None) -> DataFrame:
    """A3: rows of every shard that has a manifest row. Before any shard was
    written (an empty source) this is an empty table of ``schema``."""
    if not _exists(spark, f"{base}/data"):
        if schema is None:
            raise FileNotFoundError(f"no shards under {base}")
        return spark.createDataFrame([], schema)
    data = spark.read.parquet(f"{base}/data")
    if with_provenance:
        data = data.withColumn("file_path", F.col("_metadata.file_path"))
    if not _exists(spark, f"{base}/manifest"):
        return data.drop(RUN).limit(0)
    done = _latest(spark, base).select("shard_id", F.explode(RUN).alias(RUN))
    return data.join(done, ["shard_id", RUN], "left_semi").drop(RUN)


def numbered_files(df: DataFrame, shard_col: str, n_shards: int, split: str = "train") -> DataFrame:
    """The ``train-%05d-of-%05d.parquet`` label of each row's shard."""
    return df.withColumn("file_name", numbered_file(F.col(shard_col), F.lit(n_shards), split))


def write_numbered(df: DataFrame, out: str, shard_col: str, n_shards: int, split: str = "train") -> None:
    """One file ``out/train-00000-of-00003.parquet`` for each shard, with all
    columns of ``df`` but the shard. Rows are clustered by shard, so each folder of the partitioned write has one file; the
    driver only renames files."""
    spark = df.sparkSession
    work = f"{out}/_writing-{uuid.uuid4().hex[:8]}"
    labelled = numbered_files(df, shard_col, n_shards, split)
    labelled.repartition(shard_col).drop(shard_col).write.partitionBy("file_name").parquet(work)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{work}/file_name=*/part-*")) or []:
        name = f.getPath().getParent().getName().split("=", 1)[1]
        fs.delete(path(f"{out}/{name}"), False)   # of an earlier run
        fs.rename(f.getPath(), path(f"{out}/{name}"))
    fs.delete(path(work), True)


def descriptor(df: DataFrame, split_col: str, shard_col: str) -> DataFrame:
    """``{"splits": {<split>: {"num_shards": n}}}`` computed from the
    data; stale per-shard lengths and byte counts are not carried."""
    per = df.groupBy(split_col).agg(F.count_distinct(shard_col).cast("int").alias("num_shards"))
    splits = F.map_from_entries(F.array_sort(F.collect_list(F.struct(split_col, F.struct("num_shards")))))
    return per.agg(F.to_json(F.struct(splits.alias("splits"))).alias("dataset_info"))


STALE = ("num_shards", "num_bytes", "shard_lengths")   # of a split's entry, once its shards are written anew


def edit_descriptor(df: DataFrame, split_col: str, shard_col: str, found: str) -> DataFrame:
    """An existing descriptor (its JSON text) with the shards that ``df`` has for each split: ``num_shards`` is set, what
    else depended on the old shards goes, splits that only ``df`` knows are added, and every other key, known or
    not, keeps its value at any depth (VARIANT, no schema). A split that ``df`` lacks has no shards any more: 0. Keys come
    out sorted. ``found`` without ``splits`` gets them; text that is no JSON object is an error."""
    per = df.groupBy(split_col).agg(F.count_distinct(shard_col).cast("int").alias("n")).where(F.col(split_col).isNotNull())
    one = per.agg(F.map_from_entries(F.collect_list(F.struct(F.col(split_col).cast("string"), "n"))).alias("n"))
    one = one.withColumn("top", F.parse_json(F.lit(found)).cast("map<string,variant>"))
    stale = ", ".join(f"'{k}'" for k in STALE)
    one = one.withColumn("old", F.expr("coalesce(cast(top['splits'] as map<string,map<string,variant>>), map())"))
    one = one.withColumn("splits", F.expr(f"""map_from_entries(transform(array_sort(array_union(map_keys(old), map_keys(n))), s -> struct(s,
        map_concat(coalesce(map_filter(old[s], (k, v) -> k not in ({stale})), map()), map('num_shards', cast(coalesce(n[s], 0) as variant))))))"""))
    return one.select(F.expr("""to_json(to_variant_object(map_concat(map_filter(top, (k, v) -> k != 'splits'),
        map('splits', cast(to_variant_object(splits) as variant)))))""").alias("dataset_info"))


def _claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there: of several callers one gets True."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    try:
        if fs.getScheme() == "file":   # Hadoop's local file system looks first and creates later
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        else:
            fs.create(p, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version table: the log entries that their publishers have filled in."""
    if not _exists(spark, f"{root}/_log"):
        return spark.createDataFrame([], VERSION_SCHEMA)
    return spark.read.schema(VERSION_SCHEMA).json(f"{root}/_log/*.json").where("version is not null")


def publish_version(df: DataFrame, root: str, split: str, message: str | None) -> DataFrame:
    """A10: write ``root/version=<n>/split=<split>`` and return the version table.

    A publisher takes the next number by creating its log entry, which only one can, and fills the entry in when its data
    is written. So publishers at the same time get different numbers and none loses a row; the entry of one that
    died stays empty, its number is not given again, and no reader takes it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    log = jvm.org.apache.hadoop.fs.Path(f"{root}/_log")
    fs = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(log)
    v = 1 + max((int(f.getPath().getName()[:-5]) for f in fs.listStatus(log) if f.getPath().getName()[:-5].isdigit()), default=0)
    while not _claim(spark, f"{root}/_log/{v:08d}.json"):
        v += 1
    out = f"{root}/version={v}/split={split}"
    df.write.mode("overwrite").parquet(out)
    n = spark.read.schema(df.schema).parquet(out).count()
    entry = json.dumps({"version": v, "split": split, "num_rows": n, "message": message})
    f = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/_log/{v:08d}.json"), True)
    f.write(bytearray(entry.encode()))
    f.close()
    return published(spark, root)


__all__ = ["write_shards", "read_manifest", "resume_point", "scan_shards", "numbered_files",
           "write_numbered", "descriptor", "edit_descriptor", "publish_version", "published", "local_path"]
