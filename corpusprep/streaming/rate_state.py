"""E5 per trailing window on a stream: the rate audit with state, one output for each request.

Time is cut into buckets, as in the batch form, and callers are dealt into ``groups`` by hash: a request is kept under (group, bucket) and,
as context, under the next buckets that its window reaches into, so requests spread over tasks and a key's state is a group's traffic of
W + one bucket. A key takes a batch's rows in one piece, so calls and timers follow the number of groups and buckets, not that of the callers. An
event-time timer at the end of a bucket fires when the watermark has passed it: by then all its requests are there, whatever the
order they came in, the audit of each is written once, and the state goes. Requests later than the watermark allows are dropped, as in any
stream; requests without a time, a caller or an id are left out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusprep.streaming.rate import event_time, micros


def audit(us: np.ndarray, window_us: int, max_requests: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier requests in the window, whether they reach the limit, the wait) of requests in order."""
    oldest = np.searchsorted(us, us - window_us, "right")  # the first request with now - t < W
    prior = np.arange(len(us)) - oldest
    full = prior >= max_requests
    return prior, full, np.where(full, us[oldest] + window_us - us, 0)


def audit_callers(requests: np.ndarray, window_us: int, max_requests: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, caller, prior, full, wait) of the own requests among ``requests`` (rows of caller, us, id, own), in pieces of whole callers."""
    if not len(requests):
        return
    caller, us, ids, own = requests[np.lexsort((requests[:, 2], requests[:, 1], requests[:, 0]))].T
    at = us - us.min()
    span = int(at.max()) + window_us + 1  # callers one after another on one line of time, further apart than the window reaches
    first = np.append(np.flatnonzero(np.append(True, caller[1:] != caller[:-1])), len(caller))
    most = max(1, (1 << 62) // span)
    for k in range(0, len(first) - 1, most):
        cut = slice(first[k], first[min(k + most, len(first) - 1)])
        rank = np.searchsorted(first[k:], np.arange(cut.start, cut.stop), "right") - 1
        mine = own[cut] == 1
        yield ids[cut][mine], caller[cut][mine], *(x[mine] for x in audit(rank * span + at[cut], window_us, max_requests))


class TrailingAudit(StatefulProcessor):
    def __init__(self, window_us: int, max_requests: int, width_us: int):
        self.window_us, self.max_requests, self.width_us = window_us, max_requests, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("requests", "packed binary")  # caller, us, id, own as 64-bit numbers, row by row

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.rows.exists()
        for part in rows:
            self.rows.appendValue((part[["caller", "us", "id", "own"]].to_numpy(np.int64).tobytes(),))
        if first:
            self.handle.registerTimer(-(-(int(key[1]) + 1) * self.width_us // 1000))  # milliseconds, at the bucket's end or after it
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(b"".join(r[0] for r in self.rows.get()), np.int64).reshape(-1, 4)
        self.rows.clear()
        for ids, caller, prior, full, wait in audit_callers(kept, self.window_us, self.max_requests):
            if len(ids):
                yield pd.DataFrame({"id": ids, "caller": caller, "prior_requests": prior, "at_limit": full, "wait_us": wait})

    def close(self) -> None:
        pass


def stream_rate_audit(requests: DataFrame, caller_col: str, ts_col: str, id_col: str, window_us: int, max_requests: int, watermark: str,
                      bucket_us: int | None = None, groups: int = 64) -> DataFrame:
    """(id, caller, prior_requests, at_limit, wait_us) of each request, as ``rate_audit`` gives them. Start it within ``state_store``."""
    # the process that sets state up on the driver has none of the files added to the session: ship this module's code itself
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    width = bucket_us or window_us
    copies = math.ceil(window_us / width)
    d = requests.select(F.col(caller_col).cast("long").alias("caller"), F.col(id_col).cast("long").alias("id"), micros(ts_col).alias("us"), event_time(ts_col).alias("et"))
    d = d.where("us is not null and caller is not null and id is not null").withWatermark("et", watermark)
    b = F.floor(F.col("us") / width)
    d = d.withColumn("b", b).withColumn("bucket", F.explode(F.sequence(b, b + copies))).withColumn("own", (F.col("bucket") == F.col("b")).cast("long"))
    d = d.select(F.pmod(F.xxhash64("caller"), F.lit(groups)).alias("group"), "bucket", "caller", "us", "id", "own", "et")
    out = d.groupBy("group", "bucket").transformWithStateInPandas(
        TrailingAudit(window_us, max_requests, width), "id long, caller long, prior_requests long, at_limit boolean, wait_us long", "Append", "EventTime")
    return out.select(F.col("id").alias(id_col), F.col("caller").alias(caller_col), "prior_requests", "at_limit", "wait_us")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the queries started within; the session's own is put back."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
