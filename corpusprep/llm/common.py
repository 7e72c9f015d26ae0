"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.session import bounded_batches, materialize, ship_package

__all__ = ["bounded_batches", "cycles_kept", "materialize", "row_key", "ship_package", "table", "text_or_empty"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables, by the path that Spark reads."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


@contextmanager
def cycles_kept() -> Iterator[None]:
    """Without Python's search for cyclic garbage, for a batch of work that makes no cycles: with large caches it walks through them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def row_key(df: DataFrame) -> Column:
    """128 bits of the whole row: equal rows have equal keys, nulls included; of 10^10 different rows no two meet but by a chance of 10^-19."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                           {"ignoreNullFields": "false"}))
