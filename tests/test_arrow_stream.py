import json
import os

import pytest

from corpusprep.session import parts_by_size, tables_size
from corpusprep.sources import arrow_ipc
from corpusprep.streaming import enrich_stream as L


def test_each_file_is_read_once_over_batches_and_restarts(spark, tmp_dir):
    arrow_ipc.register(spark)
    src, log, out, ck = (f"{tmp_dir}/{n}" for n in ("src", "log", "out", "ck"))
    local = src.removeprefix("file:")

    def add(lo, hi, files):
        spark.range(lo, hi).selectExpr("id as k", "concat('t', id) as text").repartitionByRange(files, "k").write.format(arrow_ipc.FORMAT).mode("append").save(src)

    def start(most=2):
        d = spark.readStream.format(arrow_ipc.FORMAT).option("log", log).option("maxFilesPerTrigger", most).load(src)
        return d.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()

    def got():
        return sorted(r.k for r in spark.read.parquet(out).collect())

    add(0, 50, 5)
    q = start()
    q.processAllAvailable()
    assert got() == list(range(50))
    name = sorted(os.listdir(local))[0]  # one that has been read
    add(50, 60, 1)  # between triggers
    os.rename(f"{local}/{name}", f"{local}/{name}.inprogress")  # goes away and comes back
    q.processAllAvailable()
    os.rename(f"{local}/{name}.inprogress", f"{local}/{name}")
    L.drain(q)
    assert got() == list(range(60))
    entries = sorted(os.listdir(log.removeprefix("file:")))
    assert len(entries) >= 4 and all(len(json.load(open(f"{log.removeprefix('file:')}/{e}"))) <= 2 for e in entries)
    add(60, 80, 2)  # while it is stopped, with a time before all others
    for f in os.listdir(local):
        os.utime(f"{local}/{f}", (1, 1))
    L.drain(start())
    assert got() == list(range(80))
    L.drain(start(most=1))
    assert got() == list(range(80))


def test_a_planned_batch_is_planned_again_after_a_crash(spark, tmp_dir):
    src, log = f"{tmp_dir}/src", f"{tmp_dir}/log"
    arrow_ipc.register(spark)
    spark.range(9).repartitionByRange(3, "id").write.format(arrow_ipc.FORMAT).mode("append").save(src)
    first = arrow_ipc._StreamReader(src, log, 2)
    zero, one = first.initialOffset(), first.latestOffset()
    planned = [p.path for p in first.partitions(zero, one)]
    again = arrow_ipc._StreamReader(src, log, 2)  # nothing but the log is left
    assert [p.path for p in again.partitions(zero, one)] == planned and len(planned) == 2
    two = again.latestOffset()
    assert len(again.partitions(one, two)) == 1 and again.latestOffset() == two
    with pytest.raises(ValueError):
        arrow_ipc.ArrowIPCDataSource({"path": src}).streamReader(None)


def test_files_grow_in_number_not_in_size(spark, tmp_dir):
    spark.range(400_000).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text").write.parquet(f"{tmp_dir}/documents.parquet")
    d = spark.read.parquet(f"{tmp_dir}/documents.parquet").select("doc_id", "text")
    size = tables_size(d)
    assert size > 1 << 20
    assert parts_by_size(d, 4) == max(4, -(-size // (32 << 20)))
    assert parts_by_size(d, 4, 1 << 20) == -(-size // (1 << 20)) > 4
    copies = d.unionByName(d).unionByName(d)
    assert parts_by_size(copies, 1, 1 << 20) >= 3 * (parts_by_size(d, 1, 1 << 20) - 1)
