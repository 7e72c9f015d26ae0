"""Certified shards as a Spark data source for writing.

Each task writes its rows to ``data/shard_id=<n>/`` itself, as Parquet, and tells the commit which shards it
wrote, how many rows, and under which token (one for each attempt of a task, also a column of its
rows). The commit writes one manifest file from these messages alone: no data file is listed or read again, so a
run costs the same however many came before it. Rows whose token no manifest row holds belong
to a failed or repeated attempt or to a replaced run, and no reader takes them.

Rows must come sorted by shard within a partition (one open file at a time). A null shard is an
error. An empty table writes nothing.
"""

from __future__ import annotations

import itertools
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusprep.session import arrow_fs, ship_package

FORMAT = "certifiedshards"
TOKEN = "__cp_run"   # the task attempt that wrote a row
MANIFEST = pa.schema([("shard_id", pa.int32()), ("sample_count", pa.int64()), ("timestamp", pa.string()),
                      (TOKEN, pa.list_(pa.string())), ("written", pa.int64())])


@dataclass
class _Wrote(WriterCommitMessage):
    token: str
    rows: dict[int, int]
    files: list[str]                                    # what this attempt wrote
    replaced: list[str] = field(default_factory=list)   # what stood in its shards before this run


def _runs(batches: Iterator[pa.RecordBatch], shard: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of one shard, without its column."""
    for batch in batches:
        at = batch.schema.get_field_index(shard)
        ids = batch.column(at).to_pylist()
        rest = batch.drop_columns([shard])
        start = 0
        for n, same in itertools.groupby(ids):
            if n is None:
                raise ValueError("a row without a shard")
            size = sum(1 for _ in same)
            yield int(n), rest.slice(start, size)
            start += size


class _Writer(DataSourceArrowWriter):
    def __init__(self, base: str, shard: str, stamp: str):
        self.base, self.shard, self.stamp, self.run = base, shard, stamp, uuid.uuid4().hex

    def write(self, iterator):
        token = uuid.uuid4().hex
        out = _Wrote(token, {}, [])
        fs, root = arrow_fs(self.base)
        for n, stretches in itertools.groupby(_runs(iterator, self.shard), key=lambda x: x[0]):
            folder = posixpath.join(root, "data", f"shard_id={n}")
            fs.create_dir(folder, recursive=True)
            if n not in out.rows:
                found = fs.get_file_info(pafs.FileSelector(folder))
                out.replaced += [f.path for f in found if not f.base_name.startswith(f"part-{self.run}-")]
            name = f"part-{self.run}-{token}-{len(out.files):05d}.parquet"
            out.files.append(posixpath.join(folder, name))
            out.rows[n] = out.rows.get(n, 0) + self._file(fs, out.files[-1], token, (b for _, b in stretches))
        return out

    @staticmethod
    def _file(fs, path: str, token: str, batches: Iterator[pa.RecordBatch]) -> int:
        rows, first = 0, next(batches)
        schema = first.schema.append(pa.field(TOKEN, pa.string()))
        with fs.open_output_stream(path) as f, pq.ParquetWriter(f, schema, compression="snappy") as w:
            for b in itertools.chain([first], batches):
                w.write_batch(pa.RecordBatch.from_arrays([*b.columns, pa.repeat(pa.scalar(token), b.num_rows)], schema=schema))
                rows += b.num_rows
        return rows

    def commit(self, messages):
        shards: dict[int, tuple[int, list[str]]] = {}
        for m in messages:
            for n, k in (m.rows if m is not None else {}).items():
                count, tokens = shards.get(n, (0, []))
                shards[n] = (count + k, [*tokens, m.token])
        if not shards:
            return
        fs, root = arrow_fs(self.base)
        folder = posixpath.join(root, "manifest")
        fs.create_dir(folder, recursive=True)
        now = time.time_ns()
        rows = [{"shard_id": n, "sample_count": k, "timestamp": self.stamp, TOKEN: t, "written": now} for n, (k, t) in sorted(shards.items())]
        name = posixpath.join(folder, f"part-{self.run}.parquet")
        hidden = posixpath.join(folder, f"_part-{self.run}.inprogress")
        with fs.open_output_stream(hidden) as f:
            pq.write_table(pa.Table.from_pylist(rows, schema=MANIFEST), f)
        fs.move(hidden, name)   # from here on the run counts
        self._delete(fs, {f for m in messages if m is not None for f in m.replaced})

    def abort(self, messages):
        fs, _ = arrow_fs(self.base)
        self._delete(fs, {f for m in messages if m is not None for f in m.files})

    @staticmethod
    def _delete(fs, files: set[str]) -> None:
        def drop(f: str) -> None:
            try:
                fs.delete_file(f)
            except FileNotFoundError:
                pass   # another run replaced it, too

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(drop, sorted(files)))


class ShardDataSource(DataSource):
    """``df.sortWithinPartitions(shard).write.format("certifiedshards").mode("append").option("shard", ...).option("stamp", ...).save(base)``."""

    @classmethod
    def name(cls):
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("shards are replaced one by one: use append")
        return _Writer(self.options["path"], self.options["shard"], self.options["stamp"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ShardDataSource)
