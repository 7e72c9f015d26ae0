"""Positions, batches, shards and shuffles.

``ordered_index`` is the base of everything ordered. It never uses an
unpartitioned window over the data (that plans ``Exchange SinglePartition``):

1. one aggregate pass returns the row count and a bounded grid of quantiles of
   a numeric, order-preserving *proxy* of the order key;
2. every row gets ``bucket = searchsorted(boundaries, proxy)`` - a pure function
   of its own key, so recomputation after a lost executor gives the same bucket;
3. ``pos = offset[group, bucket] + row_number() over (group, bucket by key) - 1``
   where ``offset`` is the prefix sum of a ``groupBy(group, bucket).count()``.

A hot group (one user, clip or conversation holding a third of the rows) is
spread over many buckets by its key, so no task sorts the whole group.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.session import materialize

_PROXY, _BUCKET, _OFFSET = "__cp_proxy", "__cp_bucket", "__cp_offset"


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


SAMPLE_PER_BUCKET = 200


def quantile_boundaries(df: DataFrame, proxy: Column, n_buckets: int | None,
                        rows_per_bucket: int, max_buckets: int,
                        min_buckets: int = 1, seed: int = 17) -> tuple[int, list[float]]:
    """(row count, sorted distinct inner boundaries). A count decides how many
    buckets are needed; then one aggregate pass computes the quantiles - over
    a seeded Bernoulli sample of ~SAMPLE_PER_BUCKET keys per bucket when the
    table is larger, so the final merge of quantile summaries is bounded by the
    grid, not by the data. The driver receives at most ``max_buckets``
    numbers, whatever the data size; the boundaries are frozen as literals."""
    n = df.count()
    grid = n_buckets or max(1, min(max_buckets, max(min_buckets, math.ceil(n / max(1, rows_per_bucket)))))
    grid = min(grid, max(1, n))
    if grid <= 1 or n == 0:
        return n, []
    probs = [i / grid for i in range(1, grid)]
    target = grid * SAMPLE_PER_BUCKET
    src = df.sample(withReplacement=False, fraction=target / n, seed=seed) if n > 2 * target else df
    row = src.agg(F.percentile_approx(proxy, probs, max(10000, 10 * grid)).alias("q")).first()
    q = [float(v) for v in (row["q"] or []) if v is not None]
    return n, sorted(set(q))


def ordered_index(df: DataFrame, order_cols, partition_cols=None, proxy: Column | None = None,
                  pos_col: str = "pos", n_buckets: int | None = None,
                  rows_per_bucket: int = 2_000_000, max_buckets: int = 1 << 20,
                  min_buckets: int | None = None) -> DataFrame:
    """Dense 0-based position of each row in ``order_cols`` order,
    globally or within ``partition_cols``. ``order_cols`` must be unique per
    group (add a tie-breaker). ``proxy`` is a numeric column, non-decreasing in
    the order; default: the order column, if it is a single numeric one, else the rows
    are cut by ``range_index``: a first column of several may hold one value on most rows. Null groups are groups like any other."""
    order = order_cols if isinstance(order_cols, (list, tuple)) else [order_cols]
    part = _cols(partition_cols)
    prox = proxy if proxy is not None else (F.col(order[0]) if isinstance(order[0], str) else order[0])
    if proxy is None and (len(order) > 1 or not isinstance(df.select(prox.alias("p")).schema["p"].dataType, T.NumericType)):
        return range_index(df, order, part, pos_col)
    d = df.withColumn(_PROXY, F.coalesce(prox.cast("double"), F.lit(float("-inf"))))
    lo = min_buckets if min_buckets is not None else df.sparkSession.sparkContext.defaultParallelism
    n, bounds = quantile_boundaries(d, F.col(_PROXY), n_buckets, rows_per_bucket, max_buckets, lo)
    splits = [float("-inf")] + [b for b in bounds if math.isfinite(b)] + [float("inf")]
    if len(splits) < 3 and n > rows_per_bucket:
        return range_index(d.drop(_PROXY), order, part, pos_col)  # the stand-in doesn't tell the rows apart
    if len(splits) < 3:
        # one bucket of a tiny input: no offsets
        w = Window.partitionBy(*part).orderBy(*order)
        return (d.drop(_PROXY)
                 .withColumn(pos_col, (F.row_number().over(w) - 1).cast("long")))
    d = (Bucketizer(splits=splits, inputCol=_PROXY, outputCol=_BUCKET)
         .transform(d).withColumn(_BUCKET, F.col(_BUCKET).cast("int")).drop(_PROXY))
    counts = d.groupBy(*part, _BUCKET).count()
    offsets = _offsets(counts, part)
    if not part:
        # one row per bucket: bounded by max_buckets, safe to broadcast
        offsets = F.broadcast(offsets)
    return _place(d, offsets, part, order, pos_col)


def _offsets(counts: DataFrame, part: list[str]) -> DataFrame:
    w_off = (Window.partitionBy(*part).orderBy(_BUCKET)
             .rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*part, _BUCKET, F.coalesce(F.sum("count").over(w_off), F.lit(0)).alias(_OFFSET))


def _place(d: DataFrame, offsets: DataFrame, part: list[str], order: list, pos_col: str) -> DataFrame:
    """Offset of the row's bucket plus its place there; null groups join as equal."""
    o = offsets.select(*[F.col(c).alias(f"__cp_g{i}") for i, c in enumerate(part)], F.col(_BUCKET).alias("__cp_b"), _OFFSET)
    same = F.col(_BUCKET) == F.col("__cp_b")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"__cp_g{i}"))
    w_row = Window.partitionBy(*part, _BUCKET).orderBy(*order)
    return (d.join(o, same, how="inner")
             .withColumn(pos_col, (F.col(_OFFSET) + F.row_number().over(w_row) - 1).cast("long"))
             .drop(_BUCKET, _OFFSET, "__cp_b", *[f"__cp_g{i}" for i in range(len(part))]))


def range_index(df: DataFrame, order, part: list[str], pos_col: str) -> DataFrame:
    """Positions by any order key, without a numeric stand-in: rows are dealt out
    by ranges of (group, key), which Spark samples, so neither a hot group nor keys with a long common
    prefix meet in one task; each range is a bucket. The ranges are written once, so
    that the two passes over them agree."""
    d = materialize(df.repartitionByRange(*part, *order).withColumn(_BUCKET, F.spark_partition_id()), "ranges")
    return _place(d, _offsets(d.groupBy(*part, _BUCKET).count(), part), part, order, pos_col)


def batch_assign(df: DataFrame, batch_size: int, pos_col: str = "pos",
                 batch_col: str = "batch_id") -> DataFrame:
    """``batch_id = pos div B``; the last batch may be short."""
    return df.withColumn(batch_col, F.floor(F.col(pos_col) / batch_size).cast("long"))


def batch_drop_last(df: DataFrame, batch_size: int, total_rows: int,
                    pos_col: str = "pos") -> DataFrame:
    """Drop the short final batch (batches are consecutive positions, so
    only ``pos >= (n div B) * B`` can be short; no window needed)."""
    keep = (total_rows // batch_size) * batch_size
    return df.where(F.col(pos_col) < keep)


def rows_per_shard(shard_size: int, batch_size: int) -> int:
    """A shard flushes at the first batch end with >= shard_size rows."""
    return math.ceil(shard_size / batch_size) * batch_size


def shard_assign(df: DataFrame, shard_size: int, batch_size: int, start_pos: int = 0,
                 first_shard: int = 0, pos_col: str = "pos", shard_col: str = "shard_id") -> DataFrame:
    """Shard ids from ``first_shard``, counted from the resume position."""
    per = rows_per_shard(shard_size, batch_size)
    return df.withColumn(shard_col, (F.lit(first_shard) + F.floor(
        (F.col(pos_col) - start_pos) / per)).cast("int"))


def shuffle_key(id_col, seed: int, epoch: int) -> Column:
    """``md5('{seed}:{epoch}:{id}')`` - same in every engine and run."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), c.cast("string")))


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epoch: int,
                  pos_col: str = "shuffle_pos", **kw) -> DataFrame:
    """A deterministic permutation; ``pos`` in shuffled order."""
    d = df.withColumn("__cp_key", shuffle_key(id_col, seed, epoch))
    proxy = F.conv(F.substring("__cp_key", 1, 13), 16, 10).cast("double")
    return ordered_index(d, ["__cp_key", id_col], proxy=proxy, pos_col=pos_col, **kw).drop("__cp_key")


def eval_slice(df: DataFrame, order_cols, n: int = 100) -> DataFrame:
    """The first n rows in key order (TakeOrderedAndProject)."""
    return df.orderBy(*_cols(order_cols)).limit(n)


def row_peek(df: DataFrame, order_cols, row_index: int, n: int = 4) -> DataFrame:
    """N rows from ``row_index``; IndexError when it is out of range."""
    total = df.count()
    if row_index >= total:
        raise IndexError(f"row {row_index} out of range, dataset has {total} rows")
    return df.orderBy(*_cols(order_cols)).offset(row_index).limit(n)


def skip_count(processed: int, batch_size: int) -> int:
    """B6 parity: whole batches are skipped until ``skipped >= processed``."""
    return math.ceil(processed / batch_size) * batch_size if processed > 0 else 0


def resume_skip(df: DataFrame, processed: int, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """B6 positional form: drop ``ceil(processed / B) * B`` leading rows."""
    return df.where(F.col(pos_col) >= skip_count(processed, batch_size))


def resume_antijoin(df: DataFrame, done: DataFrame, keys) -> DataFrame:
    """B6/C3 key form: rows whose key is not yet in the output."""
    return df.join(done.select(*_cols(keys)), on=_cols(keys), how="left_anti")


def sample_cap(df: DataFrame, processed: int, batch_size: int, max_samples: int | None,
               pos_col: str = "pos") -> DataFrame:
    """The cap is tested before each batch and counts resumed rows, so the
    last batch may overshoot. Expects positions after ``resume_skip``."""
    if not max_samples:
        return df
    start = skip_count(processed, batch_size)
    b = F.floor((F.col(pos_col) - start) / batch_size)
    return df.where(F.lit(processed) + b * batch_size < max_samples)
