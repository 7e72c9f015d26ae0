"""A3, A7, A11 over folders: one ``shard_<8 digits>/`` for each shard, with ``data-*.arrow`` IPC stream files and, written after them, a
``metadata.json`` (shard_id, sample_count, timestamp). Only shards that have one are read or counted.

Reading: partitions are planned from the metadata, as many shards to one as give ``rowsPerPartition`` rows (option, default
100,000). Conditions on ``shard_id`` (of the folder's name) reach the planning, so no file of another shard is opened, its metadata neither.
A shard whose files hold another number of rows than its metadata says is an error. Writing: tasks write files that no reader
takes; the commit takes a replaced shard's metadata away, then its files, gives the new ones their names, and writes the metadata
from the tasks' counts. So a failed run certifies nothing, and one that dies in its commit leaves each shard whole or uncertified.
"""

from __future__ import annotations

import fnmatch
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from corpusprep.session import arrow_fs, ship_package

FORMAT = "sharddirs"
SHARD = "shard_id"
ROWS, FILES_AT_ONCE = 100_000, 16
# ---- fixed values: names of the layout ------------------------------------
FOLDER, FOLDER_NAME = "shard_{:08d}", re.compile(r"shard_(\d+)")
DATA, METADATA = "data-*.arrow", "metadata.json"
# ---------------------------------------------------------------------------
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
         LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _each(what, over: list) -> list:
    """``what`` of every item, some at a time: all of it waits for the file system."""
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        return list(pool.map(what, over))


def certified(path: str, wanted=lambda shard: True) -> list[tuple[int, str]]:
    """(shard, folder) of the wanted shards that have their metadata, in order of shards."""
    fs, root = arrow_fs(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    shards = sorted((int(m[1]), f.path) for f in found if f.type == pafs.FileType.Directory and (m := FOLDER_NAME.fullmatch(f.base_name)) and wanted(int(m[1])))
    there = fs.get_file_info([f"{folder}/{METADATA}" for _, folder in shards])
    return [s for s, f in zip(shards, there) if f.type == pafs.FileType.File]


def _data(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if fnmatch.fnmatch(f.base_name, DATA))


class _Shards(InputPartition):
    def __init__(self, shards: list[tuple[int, str, int]]):
        super().__init__(shards)
        self.shards = shards


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema, self.rows, self.conditions = path, schema, rows, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute == (SHARD,):
                self.conditions.append((type(f), f.value))
            else:
                yield f

    def partitions(self):
        fs, _ = arrow_fs(self.path)
        shards = certified(self.path, lambda shard: all(TESTS[kind](shard, value) for kind, value in self.conditions))

        def counted(shard: tuple[int, str]) -> tuple[int, str, int]:
            with fs.open_input_stream(f"{shard[1]}/{METADATA}") as f:
                return (*shard, json.loads(f.readall())["sample_count"])

        out, size = [], 0
        for s in _each(counted, shards):
            if not out or size + s[2] > self.rows:
                out.append([])
                size = 0
            out[-1].append(s)
            size += s[2]
        return [_Shards(s) for s in out]

    def read(self, partition):
        if partition is None:   # nothing was planned
            return
        fs, _ = arrow_fs(self.path)
        schema = to_arrow_schema(self.schema)
        for shard, folder, samples in partition.shards:
            rows = 0
            for name in _data(fs, folder):
                with fs.open_input_stream(name) as f:
                    for batch in pa.ipc.open_stream(f):
                        rows += batch.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * batch.num_rows, c.type) if c.name == SHARD else batch.column(c.name).cast(c.type)
                                                          for c in schema], schema=schema)
            if rows != samples:
                raise ValueError(f"{folder} holds {rows} rows, its metadata says {samples}")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, str, int]] = field(default_factory=list)   # shard, file, rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, shard: str, stamp: str):
        self.path, self.schema, self.shard, self.stamp = path, schema, shard, stamp

    def write(self, iterator):
        fs, root = arrow_fs(self.path)
        schema = to_arrow_schema(self.schema)
        at = schema.get_field_index(self.shard)
        schema = schema.remove(at)
        done, now, sink, writer = _Written(), None, None, None

        def end() -> None:
            if writer:
                writer.close()
                sink.close()

        try:
            for batch in iterator:
                shards = batch.column(at).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
                batch = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], schema=schema)
                for start, stop in zip(cuts, cuts[1:]):
                    if start == stop:
                        continue
                    if now != shards[start]:
                        end()
                        now = int(shards[start])
                        folder = f"{root}/{FOLDER.format(now)}"
                        fs.create_dir(folder, recursive=True)
                        name = f"{folder}/writing-{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(name)
                        writer = pa.ipc.new_stream(sink, schema)
                        done.files.append((now, name, 0))
                    writer.write_batch(batch.slice(start, stop - start))
                    done.files[-1] = (now, name, done.files[-1][2] + stop - start)
        finally:
            end()
        return done

    def commit(self, messages):
        fs, root = arrow_fs(self.path)
        shards: dict[int, list[tuple[str, int]]] = {}
        for m in messages:
            for shard, name, rows in m.files if m else ():
                shards.setdefault(shard, []).append((name, rows))

        def certify(item: tuple[int, list[tuple[str, int]]]) -> None:
            shard, files = item
            folder = f"{root}/{FOLDER.format(shard)}"
            if fs.get_file_info(f"{folder}/{METADATA}").type == pafs.FileType.File:
                fs.delete_file(f"{folder}/{METADATA}")
            for old in _data(fs, folder):
                fs.delete_file(old)
            for k, (name, _) in enumerate(files):
                fs.move(name, f"{folder}/data-{k:05d}-of-{len(files):05d}.arrow")
            what = {"shard_id": shard, "sample_count": sum(rows for _, rows in files), "timestamp": self.stamp}
            new = f"{folder}/writing-{uuid.uuid4().hex}"
            with fs.open_output_stream(new) as f:
                f.write(json.dumps(what, ensure_ascii=False, indent=2).encode())
            fs.move(new, f"{folder}/{METADATA}")

        _each(certify, sorted(shards.items()))

    def abort(self, messages):
        fs, _ = arrow_fs(self.path)
        _each(fs.delete_file, [name for m in messages if m for _, name, _ in m.files])


class ShardDirs(DataSource):
    """``spark.read.format("sharddirs").load(folder)``; ``write_shard_dirs`` writes."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        fs, _ = arrow_fs(self.options["path"])
        for _, folder in certified(self.options["path"]):
            for name in _data(fs, folder)[:1]:
                with fs.open_input_stream(name) as f:
                    return from_arrow_schema(pa.ipc.open_stream(f).schema).add(SHARD, IntegerType())
        raise ValueError(f"no shards under {self.options['path']!r}; give the schema to read a folder that may be empty")

    def reader(self, schema):
        return _Reader(self.options["path"], schema, int(self.options.get("rowsPerPartition", ROWS)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, self.options.get("shard", SHARD), self.options["stamp"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardDirs)


def write_shard_dirs(df: DataFrame, path: str, stamp: str, shard_col: str = SHARD) -> None:
    """Each shard replaces what an earlier run wrote for it. A task's rows are sorted by shard; a shard that several tasks hold gets
    a file from each, so cluster by shard before, for one file. A null shard is an error."""
    register(df.sparkSession)
    whole = df.withColumn(shard_col, F.coalesce(F.col(shard_col).cast("int"), F.raise_error(F.lit("a row without a shard")).cast("int")))
    whole.sortWithinPartitions(shard_col).write.format(FORMAT).mode("append").option("shard", shard_col).option("stamp", stamp).save(path)


def read_shard_dirs(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A3: the rows of all certified shards, ``shard_id`` last. ``schema`` (with ``shard_id``) is needed only where there may be none."""
    register(spark)
    r = spark.read.format(FORMAT)
    return (r.schema(schema) if schema else r).load(path)


def resume_point_of_dirs(spark: SparkSession, path: str) -> DataFrame:
    """(rows of all certified shards, greatest of their numbers); (0, -1) if there are none. One job over the small metadata files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard_*/{METADATA}")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        m = spark.read.schema("sample_count bigint").json(p.toString(), multiLine=True)
        m = m.select("sample_count", F.regexp_extract("_metadata.file_path", r"/shard_(\d+)/[^/]*$", 1).cast("int").alias("shard"))
    else:
        m = spark.createDataFrame([], "sample_count bigint, shard int")
    return m.agg(F.coalesce(F.sum("sample_count"), F.lit(0)).cast("long").alias("processed"), F.coalesce(F.max("shard"), F.lit(-1)).alias("last_shard_id"))
