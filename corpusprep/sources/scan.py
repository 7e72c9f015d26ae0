"""Batch scans A1, A3, A5 and the profile A12."""

from __future__ import annotations

import glob as _glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.session import local_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_corpus(spark: SparkSession, root: str, subset: str | None = None, split: str | None = None,
                subset_col: str = "subset", split_col: str = "split",
                schema: T.StructType | None = None) -> DataFrame:
    """A1: a named corpus; on a ``subset=/split=`` layout the predicates prune
    partitions, on a flat file they are pushed into the Parquet scan."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(root)
    if subset is not None:
        df = df.where(F.col(subset_col) == subset)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    return df


def glob_scan(spark: SparkSession, pattern: str) -> DataFrame:
    """A5: Parquet files by glob; a clear error when nothing matches."""
    p = local_path(pattern)
    if "://" not in p and not _glob.glob(p):
        parent = os.path.dirname(p) or "."
        listing = sorted(os.listdir(parent)) if os.path.isdir(parent) else []
        raise ValueError(f"no parquet files match {pattern!r} (cwd {os.getcwd()}, "
                         f"{parent} holds {listing[:50]})")
    return spark.read.parquet(pattern)


def profile(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: name, type, rows, nulls, distinct values - all
    from a single aggregate pass (approximate distinct unless asked)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"__null_{f.name}"))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            aggs.append(F.lit(None).cast("long").alias(f"__dist_{f.name}"))
        elif exact_distinct:
            # long values travel as a 16-byte digest, not as themselves
            d = F.unhex(F.md5(c.cast("binary"))) if isinstance(f.dataType, T.StringType) else c
            aggs.append(F.count_distinct(d).alias(f"__dist_{f.name}"))
        else:
            aggs.append(F.approx_count_distinct(c).alias(f"__dist_{f.name}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col("__n").cast("long").alias("n_rows"),
                     F.col(f"__null_{f.name}").cast("long").alias("n_nulls"),
                     F.col(f"__dist_{f.name}").cast("long").alias("n_distinct"))
            for i, f in enumerate(df.schema.fields)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
