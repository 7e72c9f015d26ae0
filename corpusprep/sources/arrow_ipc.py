"""A4, A2: Arrow IPC stream files as a Spark data source (read, write, and read as a stream).

Reading: one input partition per file, files in name order, each yields its
record batches (no row conversion). Option ``positions=true`` adds ``file_no`` (place of the file in
name order) and ``row_no`` (row in its file), which together order all rows as written. Writing: each task writes its partition
to one ``part-<partition>-<uuid>.arrows`` stream file.

As a stream: the files that no micro-batch has had yet, in name order, at most ``maxFilesPerTrigger`` (option, default all) to a
batch. Option ``log`` names a folder of the query's own, in which each batch's file names are written before the batch is
planned; an offset is the number of such entries. So a file is read once whenever it shows up (a writer's rename may come late, times
may run backwards), offsets stay small, and a restart plans the same batches again.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from corpusprep.session import arrow_fs, ship_package

FORMAT = "arrowipc"
POSITIONS = ("file_no", "row_no")


def _files(path: str) -> list[str]:
    """Arrow IPC files under a folder (recursively) or matching a file glob,
    in name order; works on any pyarrow filesystem."""
    fs, p = arrow_fs(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
        names = [f.path for f in found if f.type == pafs.FileType.File
                 and ".arrow" in posixpath.basename(f.path) and not f.path.endswith(".inprogress")]
    else:
        parent, pattern = posixpath.split(p)
        found = fs.get_file_info(pafs.FileSelector(parent or ".", recursive=False, allow_not_found=True))
        names = [f.path for f in found if fnmatch.fnmatch(posixpath.basename(f.path), pattern)]
    prefix = path[: len(path) - len(p)] if "://" in path and path.endswith(p) else ""
    return sorted(prefix + n for n in names)


class _FilePartition(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__(path)
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, path: str, positions: bool):
        self.path, self.positions = path, positions

    def partitions(self):
        return [_FilePartition(f, i) for i, f in enumerate(_files(self.path))]

    def read(self, partition):
        fs, p = arrow_fs(partition.path)
        row = 0
        with fs.open_input_stream(p) as f:
            for batch in pa.ipc.open_stream(f):
                if self.positions:
                    n = batch.num_rows
                    place = [pa.array([partition.number] * n, pa.int32()), pa.array(range(row, row + n), pa.int64())]
                    row += n
                    batch = pa.RecordBatch.from_arrays([*batch.columns, *place], names=[*batch.schema.names, *POSITIONS])
                yield batch


class _StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, path: str, log: str, most: int | None):
        super().__init__(path, False)
        self.log, self.most, self.seen, self.entries = log, most, set(), 0

    def _entry(self, number: int) -> list[str]:
        fs, root = arrow_fs(self.log)
        with fs.open_input_stream(f"{root}/{number:09d}.json") as f:
            return json.loads(f.readall())

    def _catch_up(self) -> None:
        """Take over what the log has, whoever wrote it."""
        fs, root = arrow_fs(self.log)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        last = max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=0)
        while self.entries < last:
            self.entries += 1
            self.seen.update(self._entry(self.entries))

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        new = [f for f in _files(self.path) if f not in self.seen][:self.most]
        if new:
            fs, root = arrow_fs(self.log)
            fs.create_dir(root, recursive=True)
            name = f"{root}/{self.entries + 1:09d}.json"
            with fs.open_output_stream(name + ".inprogress") as f:
                f.write(json.dumps(new).encode())
            fs.move(name + ".inprogress", name)
            self._catch_up()
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [f for n in range(start["entries"] + 1, end["entries"] + 1) for f in self._entry(n)]
        return [_FilePartition(f, i) for i, f in enumerate(names)]

    def commit(self, end: dict) -> None:
        pass  # the log is what tells old files from new ones


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool = False):
        self.path = path
        self.schema = schema
        # files that stood there before an overwrite; they go when the new ones are committed
        self.old = _files(path) if overwrite else []

    def write(self, iterator):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        fs, root = arrow_fs(self.path)
        fs.create_dir(root, recursive=True)
        name = posixpath.join(root, f"part-{pid:05d}-{uuid.uuid4().hex[:8]}.arrows")
        tmp = name + ".inprogress"
        rows = 0
        schema = to_arrow_schema(self.schema)
        with fs.open_output_stream(tmp) as f, pa.ipc.new_stream(f, schema) as w:
            for batch in iterator:
                w.write_batch(batch)
                rows += batch.num_rows
        return _Written(name, rows)

    def commit(self, messages):
        """Only files of successful attempts get their final name."""
        fs, _ = arrow_fs(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.path + ".inprogress", m.path)
        for f in self.old:
            at, p = arrow_fs(f)
            at.delete_file(p)

    def abort(self, messages):
        fs, _ = arrow_fs(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.path + ".inprogress").type == pafs.FileType.File:
                fs.delete_file(m.path + ".inprogress")


class ArrowIPCDataSource(DataSource):
    """``spark.read.format("arrowipc").load(dir_or_glob)`` /
    ``df.write.format("arrowipc").mode("append").save(dir)``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow IPC files under {self.options['path']!r}")
        fs, p = arrow_fs(files[0])
        with fs.open_input_stream(p) as f:
            found = from_arrow_schema(pa.ipc.open_stream(f).schema)
        if self._positions():
            found = found.add(POSITIONS[0], IntegerType()).add(POSITIONS[1], LongType())
        return found

    def _positions(self) -> bool:
        return str(self.options.get("positions", "false")).lower() == "true"

    def reader(self, schema):
        return _Reader(self.options["path"], self._positions())

    def streamReader(self, schema):
        if "log" not in self.options:
            raise ValueError("a stream needs the option log: a folder of its own for the names of the files it has had")
        most = self.options.get("maxFilesPerTrigger")
        return _StreamReader(self.options["path"], self.options["log"], int(most) if most else None)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)  # the workers unpickle these classes by reference
    spark.dataSource.register(ArrowIPCDataSource)
