"""Session and scratch-space helpers.

Jobs never invent a machine-local temp folder: scratch output goes under the
shared folder named by ``spark.checkpoint.dir``. Only when the session has none
(unit tests, a laptop) do we create one, and then we register it so that
``DataFrame.checkpoint`` uses the same place.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a re-run task must not repeat a paid model call twice in parallel
    "spark.speculation": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "corpusprep", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; set one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named folder under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    path = f"{root}/corpusprep/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the Python-side file APIs."""
    return path[5:] if path.startswith("file:") else path


def spread(df, min_partitions: int | None = None):
    """Give CPU-heavy per-row work (model calls, regexes, lookups) at least
    one partition per core. Only rows read from tables too small to
    fill the cores with splits are dealt out round-robin (which Spark makes retry-safe
    by sorting first); others pass through untouched. The size is that of the tables the plan
    reads, not the optimizer's estimate of its result (that of a join is the product of its sides): nothing is executed."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if tables_size(df) >= want * split else df.repartition(want)


def tables_size(df) -> int:
    """The bytes of the tables that the plan of ``df`` reads, as they are stored."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def parts_by_size(df, least: int, part_bytes: int = 32 << 20) -> int:
    """How many parts to write ``df`` in, so that a part's bytes don't grow with the table."""
    return max(least, -(-tables_size(df) // part_bytes))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by bytes as well as by rows,
    so that a run of very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def materialize(df, name: str):
    """Cut lineage by writing a Parquet table under the shared checkpoint
    folder and reading it back: one pass, columnar, survives lost executors
    (unlike a local checkpoint, and unlike ``checkpoint()`` it does not
    recompute an uncached plan to write it)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``corpusprep`` importable on every executor (UDFs defined in it
    are pickled by reference): zip the package once per application and
    ``addPyFile`` it. Idempotent."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import io

    import corpusprep
    pkg = os.path.dirname(os.path.abspath(corpusprep.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    root = checkpoint_root(spark)
    zpath = f"{root}/corpusprep-pkg/corpusprep-{uuid.uuid4().hex[:8]}.zip"
    fs, p = arrow_fs(zpath)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as out:   # into the shared folder, not a local temp dir
        out.write(buf.getvalue())
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def arrow_fs(path: str):
    """(pyarrow filesystem, path inside it) for a local path or any URI
    pyarrow understands (file://, hdfs://, s3://, gs://, ...), so that
    Python-side readers and writers work on a cluster's shared folder."""
    from pyarrow import fs as pafs
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), local_path(path)
