import datetime
import random

import numpy as np

from corpusprep.streaming import enrich_stream as L
from corpusprep.streaming import rate as RT
from corpusprep.streaming import rate_state as RS

DAY, W = datetime.datetime(2024, 1, 1), 60_000_000


def test_audit_of_a_run_of_requests():
    us = np.array(sorted(random.Random(1).choices(range(0, 500_000_000, 7_000_000), k=120)), np.int64)
    prior, full, wait = RS.audit(us, W, 3)
    for i, t in enumerate(us.tolist()):
        window = [x for x in us[:i].tolist() if t - x < W]
        assert prior[i] == len(window) and full[i] == (len(window) >= 3)
        assert wait[i] == (window[0] + W - t if len(window) >= 3 else 0)


def test_stream_equals_batch_after_a_restart_with_late_and_equal_times(spark, tmp_dir):
    r = random.Random(2)
    rows = []
    for i in range(240):  # two requests at a time now and then; one caller makes half of all
        second = (i - r.randrange(2)) * 11
        rows.append((i, r.choice([1, 1, 1, 2, 3]), DAY + datetime.timedelta(seconds=second)))
    schema = "event_id long, user_id long, ts timestamp_ntz"
    late = [rows[k:k + 40] for k in range(0, 240, 40)]
    for part in late:  # out of order within the watermark's ten minutes
        r.shuffle(part)
    src, out, ck = (f"{tmp_dir}/{n}" for n in ("src", "out", "ck"))
    last = (-1, -1, DAY + datetime.timedelta(days=2))
    ignored = [(900, None, DAY), (None, 1, DAY), (901, 1, None)]

    def run():
        with RS.state_store(spark):
            d = RS.stream_rate_audit(L.source_stream(spark, src, spark.createDataFrame([], schema).schema, 1), "user_id", "ts", "event_id", W, 3, "10 minutes", bucket_us=40_000_000)
            L.run_to_end(L.stream_to_parquet(d, out, ck))

    for part in [late[0] + ignored, late[1], late[2]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    run()
    early = spark.read.parquet(out).count()
    assert 0 < early < 120  # what the watermark has passed is out, the rest is in the state
    for part in [*late[3:], [last]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    run()  # goes on from the checkpoint
    got = sorted(tuple(x) for x in spark.read.parquet(out).select("event_id", "user_id", "prior_requests", "at_limit", "wait_us").collect())
    batch = RT.rate_audit(spark.createDataFrame(rows, schema), "user_id", "ts", "event_id", W, 3)
    assert got == sorted(tuple(x) for x in batch.select("event_id", "user_id", "prior_requests", "at_limit", "wait_us").collect())
    assert any(x[3] for x in got)


def test_audit_of_many_callers_at_once():
    r = random.Random(5)
    rows = [(r.randrange(-3, 4), r.randrange(0, 300_000_000, 7_000_000), i, r.randrange(2)) for i in range(400)]
    want = {}
    for caller in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == caller), key=lambda x: (x[1], x[2]))
        for x, prior, full, wait in zip(mine, *RS.audit(np.array([x[1] for x in mine], np.int64), W, 3)):
            if x[3]:
                want[x[2]] = (caller, prior, full, wait)
    for window in (W, 1 << 61):  # the second: a caller to a piece
        got = {i: tuple(x) for part in RS.audit_callers(np.array(rows, np.int64), window, 3) for i, *x in zip(*part)}
        assert set(got) == set(want) and (window > W or got == want)
    assert list(RS.audit_callers(np.zeros((0, 4), np.int64), W, 3)) == []


def test_state_does_not_grow_with_the_number_of_callers(spark, tmp_dir):
    src, out, ck = (f"{tmp_dir}/{n}" for n in ("src", "out", "ck"))
    rows = spark.range(3000).selectExpr("id as event_id", "id as user_id", "timestamp_ntz'2024-01-01 00:00:10' as ts")
    rows.coalesce(1).write.parquet(src)
    with RS.state_store(spark):
        q = L.stream_to_parquet(RS.stream_rate_audit(L.source_stream(spark, src, rows.schema, 1), "user_id", "ts", "event_id", W, 3, "10 minutes", groups=8), out, ck)
        L.run_to_end(q)
    held = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    assert 0 < held < 300  # a few pieces for each group and bucket, not one for each caller
