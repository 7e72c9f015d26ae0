"""Sharding by longest processing time: groups that must stay together, sorted
by size, go to the least loaded shard through a heap.

The heap sees a bounded list of jobs. A group of at least 1/(shards * fine) of
all bytes is a job of its own (there can be at most shards * fine of them); the
smaller groups are hashed whole into shards * fine buckets, each a job. So at
most 2 * shards * fine (key, bytes) pairs reach the driver, whatever the size of the
table, and the loads differ by at most about one part in ``fine`` plus the largest group.

Slots number the rows of a shard without gaps: rows are written once with a row
number, counted by (shard, block of 1024 row numbers), and numbered inside a block, so a
group that holds a third of all rows is counted in many tasks.

Defined results: a null text has no bytes (size ``overhead``) and is a group with the
empty texts; repeated rows share their group's shard and have slots of their own;
empty in, empty out. Columns of the input that have the name of a result column
are replaced; other columns pass through.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import materialize, text_or_empty

FINE, OVERHEAD = 1000, 16
RESULT = ("size", "text_crc32", "shard", "slot")


def longest_first(jobs: list[tuple], n_shards: int) -> list[int]:
    """The shard of each job (bytes last in its tuple): largest first, ties by
    the rest of the tuple, each to the least loaded shard (ties: the lowest)."""
    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * len(jobs)
    for k in sorted(range(len(jobs)), key=lambda k: (-jobs[k][-1], jobs[k][:-1])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + jobs[k][-1], s))
        shard[k] = s
    return shard


def shard_rows(df: DataFrame, n_shards: int, text_col: str = "text", fine: int = FINE, overhead: int = OVERHEAD) -> DataFrame:
    """``df`` without its text and with size, text_crc32, shard and slot."""
    spark, n_jobs = df.sparkSession, n_shards * fine
    t = text_or_empty(text_col)
    rest = [c for c in df.columns if c.lower() not in RESULT and c.lower() != text_col.lower()]
    rows = materialize(df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"), (F.octet_length(t) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    bucket = F.pmod("h1", F.lit(n_jobs))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * F.lit(n_jobs).cast("decimal(20,0)") >= F.lit(total)
    # one row for each large group, one for each bucket of the others: bounded by 2 * n_jobs
    jobs = (groups.select(F.when(large, F.col("h1")).alias("h1"), F.when(large, F.col("h2")).alias("h2"),
                          F.when(~large, bucket).alias("b"), "bytes")
            .groupBy("h1", "h2", "b").agg(F.sum("bytes").alias("bytes")))
    got = [(r.h1, r.h2, r.b, int(r.bytes)) for r in jobs.toLocalIterator()]
    placed = longest_first([tuple(-1 if x is None else x for x in (j[2], j[0], j[1])) + (j[3],) for j in got], n_shards)

    def known(kind: list[str], keep) -> DataFrame:
        found = [(*(j[("h1", "h2", "b").index(k)] for k in kind), s) for j, s in zip(got, placed) if keep(j)]
        schema = ", ".join(f"{k} bigint" for k in kind) + ", s int"
        if not found:
            return spark.createDataFrame([], schema)
        return spark.createDataFrame(pd.DataFrame(found, columns=[*kind, "s"]).astype({**dict.fromkeys(kind, "int64"), "s": "int32"}), schema)

    own = known(["h1", "h2"], lambda j: j[2] is None).withColumnRenamed("s", "own")
    shared = known(["b"], lambda j: j[2] is not None)
    rows = (rows.withColumn("b", bucket).join(F.broadcast(own), ["h1", "h2"], "left").join(F.broadcast(shared), "b", "left")
            .select("r", "size", "text_crc32", F.coalesce("own", "s").alias("shard"), "row", F.shiftright("row", 10).alias("block")))
    counts = rows.groupBy("shard", "block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return (rows.join(offsets, ["shard", "block"]).withColumn("slot", (F.col("before") + place).cast("long"))
            .select("r.*", "size", "text_crc32", "shard", "slot"))
