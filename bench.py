"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (nothing is
collected to the driver). A query's time is the best of $BENCH_REPEAT runs
(default 2: the first run pays JIT compilation of its code paths, the second
is the warm time). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusprep.plans.catalog import REGISTRY  # noqa: E402
from corpusprep.session import get_spark  # noqa: E402

HEADLINE = [
    "sft_prompt", "clean_corpus", "span_split", "global_index", "epoch_shuffle",
    "shard_assign", "vocab", "token_ids", "pad_batch", "chat_labels", "detokenise",
    "segment_rejoin", "frame_stack", "mask_downsample", "resample_linear",
    "cer_micro", "wer_micro", "metric_rollup", "topk_metric", "rate_audit",
    "render_chat", "map_strip_prefix", "shard_manifest", "stream_enrich", "stream_rate",
]


def run(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    df = REGISTRY[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    run(spark, "sft_prompt", sf)  # warm-up: JVM, Python workers, code caches
    times = {}
    for q in only:
        times[q] = round(min(run(spark, q, sf) for _ in range(repeat)), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_name}))
    spark.stop()


if __name__ == "__main__":
    main()
