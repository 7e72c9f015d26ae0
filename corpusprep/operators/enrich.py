"""Model-backed row rewriting K1-K4 and error routing B8.

``enrich`` is the one place where rows leave the JVM: each partition builds
its client once and keeps at most ``max_in_flight`` calls running in a thread
pool; results keep input order. Cluster-wide concurrency is
``tasks x max_in_flight``; ``repartition`` before ``enrich`` sets it. Cleaning
and error handling run afterwards as Catalyst expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.session import materialize, spread
from corpusprep.functions.text import (ERROR_PREFIX, clean_corpus, error_text, is_error,
                                       unicode_strip)

# ---- fixed values: the enrichment request --------------------------------
START_MARK = "[startofspeech]"
END_MARK = "[endofspeech]"
# ---------------------------------------------------------------------------


class OfflineClient:
    """Deterministic stand-in for the remote model (no network): the answer is
    the first half of the text, ``[startofspeech]``, the second half,
    ``[endofspeech]``; keys divisible by ``fail_every`` fail with ``offline``."""

    def __init__(self, fail_every: int = 97):
        self.fail_every = fail_every

    def __call__(self, key, text: str) -> str:
        if self.fail_every and key is not None and key % self.fail_every == 0:
            raise RuntimeError("offline")
        half = len(text) // 2
        return text[:half] + START_MARK + text[half:] + END_MARK


class EchoClient:
    """Deterministic stand-in for a transcription / generation model (K2):
    returns its input. Real models plug in the same way as for K1."""

    def __call__(self, key, text: str) -> str:
        return text


class RetryingCall:
    """K4: ``attempts`` tries with exponential backoff clamped to
    [min_wait, max_wait] seconds on the listed exception types. The default of
    one attempt matches the reference, where the retry never fires."""

    def __init__(self, fn: Callable, attempts: int = 1, min_wait: float = 4.0,
                 max_wait: float = 10.0, retry_on=(ConnectionError, TimeoutError),
                 sleep: Callable[[float], None] = time.sleep):
        self.fn, self.attempts = fn, attempts
        self.min_wait, self.max_wait = min_wait, max_wait
        self.retry_on, self.sleep = retry_on, sleep

    def __call__(self, *args):
        for i in range(1, self.attempts + 1):
            try:
                return self.fn(*args)
            except self.retry_on:
                if i == self.attempts:
                    raise
                self.sleep(min(self.max_wait, max(self.min_wait, 2.0 ** i)))


def _guarded(call: Callable, key, text):
    """Failures become ``ERROR: <msg>`` rows instead of failing the task."""
    if text is None:
        return None
    try:
        return call(key, text)
    except Exception as e:  # noqa: BLE001 - every failure is routed, as in the reference
        return ERROR_PREFIX + str(e)


def enrich_raw(df: DataFrame, key: str, text_col: str, client_factory: Callable[[], Callable],
               out: str = "raw_answer", max_in_flight: int = 50, attempts: int = 1) -> DataFrame:
    """K1 core: append the model's raw answer (or the error sentinel)."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = RetryingCall(client_factory(), attempts=attempts)
        with ThreadPoolExecutor(max_workers=max_in_flight) as pool:
            for b in batches:
                keys = b.column(key).to_pylist()
                texts = b.column(text_col).to_pylist()
                answers = list(pool.map(lambda kt: _guarded(call, *kt), zip(keys, texts)))
                yield pa.RecordBatch.from_arrays(
                    b.columns + [pa.array(answers, pa.string())], schema=pa.schema(
                        list(b.schema) + [pa.field(out, pa.string())]))

    return df.mapInArrow(run, schema)


def enrich(df: DataFrame, key: str = "doc_id", text_col: str = "text",
           client_factory: Callable[[], Callable] = OfflineClient, out: str = "step1_text",
           max_in_flight: int = 50, attempts: int = 1, keep=()) -> DataFrame:
    """K1: ``original_text`` + cleaned answer ``step1_text`` (strip, then F1);
    error rows keep the uncleaned sentinel. ``keep`` columns ride along, so
    positions or shard ids never force a second pass over the model."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    raw = enrich_raw(spread(df.select(key, text_col, *keep)), key, text_col, client_factory,
                     out="__cp_raw", max_in_flight=max_in_flight, attempts=attempts)
    step = F.when(is_error(F.col("__cp_raw")), F.col("__cp_raw")).otherwise(
        clean_corpus(unicode_strip(F.col("__cp_raw"))))
    return raw.select(key, *keep, F.col(text_col).alias("original_text"), step.alias(out))


def error_split(df: DataFrame, col: str = "step1_text") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) by the sentinel. The rows are written
    once, so the two frames don't call the model twice."""
    df = materialize(df, "answers")
    bad = is_error(F.col(col))
    return df.where(~bad | F.col(col).isNull()), df.where(bad)


def error_status(df: DataFrame, col: str = "step1_text") -> DataFrame:
    """B8 inline form: a status column and the message of failed rows."""
    bad = is_error(F.col(col))
    return (df.withColumn("status", F.when(bad, "error").otherwise("ok"))
              .withColumn("message", F.when(bad, F.substring(F.col(col), len(ERROR_PREFIX) + 1, 1 << 30))))


def collate(df: DataFrame, batch_col: str, fn: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """K3: a per-batch collate hook (``list[row] -> batch``) as grouped Arrow."""
    return df.groupBy(batch_col).applyInArrow(fn, schema)


__all__ = ["OfflineClient", "EchoClient", "RetryingCall", "enrich_raw", "enrich", "error_split",
           "error_status", "collate", "error_text"]
