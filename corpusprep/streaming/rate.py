"""E5 (batch) and L3 (stream): request-rate windows.

E5 is the reference's sliding-window limiter, audited after the fact: for each
request, the earlier requests of the same caller with ``now - t < W``; when
there are ``max_requests`` or more, the wait is ``oldest + W - now``.

Skew: a single caller may own a third of all requests, so the window is not
partitioned by caller alone. Time is cut into buckets of width ``bucket_us``
(default W); every row is also copied, as context, into the next
``ceil(W / bucket_us)`` buckets. A request's whole window then lies in its own
partition (caller, bucket), whose size is bounded by the caller's traffic in
``W + bucket_us`` of time; a smaller ``bucket_us`` splits even a caller that
floods one window, at the cost of more context copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts_col: str) -> Column:
    """Microseconds since the epoch for TIMESTAMP_NTZ (no session time zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts_col}`)")


def rate_audit(df: DataFrame, caller_col: str, ts_col: str, id_col: str,
               window_us: int, max_requests: int, bucket_us: int | None = None) -> DataFrame:
    width = bucket_us or window_us
    copies = math.ceil(window_us / width)
    us = micros(ts_col)
    base = df.select(caller_col, id_col, us.alias("__cp_us"))
    b = F.floor(F.col("__cp_us") / width)
    own = base.withColumn("__cp_b", b).withColumn("__cp_own", F.lit(True))
    ctx = (base.withColumn("__cp_b", F.explode(F.sequence(b + 1, b + copies)))
               .withColumn("__cp_own", F.lit(False)))
    arrive = own.unionByName(ctx).withColumn("__cp_t", F.col("__cp_us")).withColumn("__cp_in", F.lit(1))
    # a request leaves the window when W has passed, before a request of that very moment
    leave = arrive.withColumn("__cp_t", F.col("__cp_us") + window_us).withColumn("__cp_in", F.lit(0)).withColumn("__cp_own", F.lit(False))
    part, upto = [caller_col, "__cp_b"], (Window.unboundedPreceding, 0)
    order = ["__cp_t", "__cp_in", id_col]
    ahead = Window.partitionBy(*part).orderBy(*order).rowsBetween(*upto)
    back = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order]).rowsBetween(*upto)
    # running counts: time follows the number of requests, even of a caller that floods one window
    prior = F.sum(2 * F.col("__cp_in") - 1).over(ahead) - 1
    next_out = F.last(F.when(F.col("__cp_in") == 0, F.col("__cp_t")), ignorenulls=True).over(back)
    out = (arrive.unionByName(leave).withColumn("prior_requests", prior.cast("long")).withColumn("__cp_next", next_out)
             .where("__cp_own"))
    at_limit = F.col("prior_requests") >= max_requests
    return out.select(id_col, caller_col, "prior_requests", at_limit.alias("at_limit"),
                      F.when(at_limit, F.col("__cp_next") - F.col("__cp_us"))
                       .otherwise(F.lit(0)).cast("long").alias("wait_us"))


def event_time(ts_col: str) -> Column:
    """A TIMESTAMP for watermarks. TIMESTAMP_NTZ wall-clock time is read as UTC
    through epoch microseconds, so the session time zone cannot shift it."""
    return F.timestamp_micros(micros(ts_col))


def to_ntz(ts: Column) -> Column:
    """Back to wall-clock TIMESTAMP_NTZ (UTC reading), independent of the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def windowed_rates(events: DataFrame, ts_col: str, group_col: str, value_col: str,
                   length: str, slide: str, watermark: str) -> DataFrame:
    """L3: sliding windows with a watermark; in append mode a window is
    emitted once the watermark passes its end and its state is dropped."""
    return (events.withColumn("__cp_et", event_time(ts_col))
                  .withWatermark("__cp_et", watermark)
                  .groupBy(F.window("__cp_et", length, slide).alias("w"), group_col)
                  .agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"))
                  .select(to_ntz(F.col("w.start")).alias("window_start"),
                          to_ntz(F.col("w.end")).alias("window_end"), group_col, "n", "total"))
