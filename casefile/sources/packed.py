"""Lines of many items packed into files of bounded size, with an index from an item to its files and places.

A package is a folder with data files, index files and a manifest, which the driver writes last: without it there is no package. Tasks
write files under names of their own, so what failed or repeated tasks leave behind is never listed. Folders are reached by
pyarrow's file systems (local or shared paths, s3, hdfs, gs)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of a data file before the next one is begun; runs that a task notes before it writes them; bytes read at a time.
FILE_BYTES, NOTED, READ = 64 << 20, 10_000, 1 << 20
INDEX = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64()), ("sha256", pa.string())])
INDEX_DDL = "key string, file string, offset long, length long, lines long, sha256 string"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:")) if path.startswith(("/", "file:")) else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    index: str
    lines: int


class _Task:
    """One task's data files and its index."""

    def __init__(self, path: str, most: int):
        self.fs, self.base = store(path)
        context = TaskContext.get()
        self.name = f"{context.partitionId() if context else 0:07d}-{uuid.uuid4().hex}"
        self.most, self.files, self.out, self.at, self.run, self.noted, self.lines = most, [], None, 0, None, [], 0
        for folder in ("data", "index"):
            self.fs.create_dir(f"{self.base}/{folder}")
        self.index = pq.ParquetWriter(f"{self.base}/index/{self.name}.parquet", INDEX, filesystem=self.fs)

    def _note(self) -> None:
        if self.run:
            key, offset, lines, hash_ = self.run
            self.noted.append((key, self.files[-1], offset, self.at - offset, lines, hash_.hexdigest()))
            self.run = None
        if len(self.noted) >= NOTED:
            self._flush()

    def _flush(self) -> None:
        if self.noted:
            self.index.write_table(pa.table([list(c) for c in zip(*self.noted)], schema=INDEX))
            self.noted = []

    def add(self, key: str, data: memoryview, lines: int = 1) -> None:
        """Lines of one key, each with its end, that go to one file."""
        if self.out is None or (self.at and self.at + len(data) > self.most):
            self._note()
            self.close_file()
            self.files.append(f"data/{self.name}-{len(self.files):05d}")
            self.out, self.at = self.fs.open_output_stream(f"{self.base}/{self.files[-1]}"), 0
        if self.run is None or self.run[0] != key:
            self._note()
            self.run = [key, self.at, 0, hashlib.sha256()]
        self.out.write(data)
        self.run[2] += lines
        self.run[3].update(data)
        self.at += len(data)
        self.lines += lines

    def add_batch(self, keys: pa.Array, lines: pa.Array) -> None:
        """Runs of equal keys; a run that its file cannot take whole goes line by line."""
        kept = pc.is_valid(lines)
        keys, lines = keys.filter(kept), lines.filter(kept)
        if not len(keys):
            return
        ended = pc.binary_join_element_wise(lines.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        ends = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1].tolist()
        data = memoryview(ended.buffers()[2])
        firsts = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]
        for key, i, j in zip(keys.take(pa.array(firsts[:-1])).to_pylist(), firsts, firsts[1:]):
            if self.out is not None and self.at + ends[j] - ends[i] <= self.most:
                self.add(key, data[ends[i] : ends[j]], j - i)
            else:
                for k in range(i, j):
                    self.add(key, data[ends[k] : ends[k + 1]])

    def close_file(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def end(self) -> Written:
        self._note()
        self._flush()
        self.close_file()
        self.index.close()
        return Written(self.files, f"index/{self.name}.parquet", self.lines)


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = _Task(self.path, self.most)
        for batch in iterator:
            task.add_batch(batch.column(0), batch.column(1))
        return task.end()

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = store(self.path)
        done = [m for m in messages if m is not None]
        body = {"files": sorted(f for m in done for f in m.files), "index": sorted(m.index for m in done if m.lines), "lines": sum(m.lines for m in done)}
        for folder, kept in (("data", set(body["files"])), ("index", set(body["index"]))):
            selector = pafs.FileSelector(f"{base}/{folder}", allow_not_found=True)
            for stray in (f for f in fs.get_file_info(selector) if f"{folder}/{f.base_name}" not in kept):
                fs.delete_file(stray.path)
        with fs.open_output_stream(f"{base}/manifest.json") as out:
            out.write(json.dumps(body).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """What a package that failed has written goes. A task that is still running may write on; its files are listed nowhere,
        and go when a package is written at this place."""
        fs, base = store(self.path)
        for folder in ("data", "index"):
            if fs.get_file_info(f"{base}/{folder}").type == pafs.FileType.Directory:
                fs.delete_dir(f"{base}/{folder}")


class PackedSource(DataSource):
    """``df.write.format("casefile_packed").option("path", ...)`` of rows (key, line)."""

    @classmethod
    def name(cls) -> str:
        return "casefile_packed"

    def schema(self) -> str:
        return "key string, line string"

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        path = self.options["path"]
        fs, base = store(path)
        if fs.get_file_info(f"{base}/manifest.json").type != pafs.FileType.NotFound:
            raise ValueError(f"there is a package at {path} already")
        return PackedWriter(path, int(self.options.get("filebytes", FILE_BYTES)))


def pack(df: DataFrame, key: Column, line: Column, order: list[Column], path: str, file_bytes: int = FILE_BYTES) -> None:
    """A package of ``line`` by ``key``: lines of one key come together in the order of ``order``, over as many files as they need.
    Rows are dealt by ranges, so a key with very many lines is not one task's. Lines that are null are left out by the writer: a filter
    here would make each line once more."""
    rows = df.select(key.cast("string").alias("key"), line.alias("line"), *[c.alias(f"_{k}") for k, c in enumerate(order)]).filter("key is not null")
    by = ["key", *[f"_{k}" for k in range(len(order))]]
    df.sparkSession.dataSource.register(PackedSource)
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "line").write.format("casefile_packed").option("path", path).option("filebytes", str(file_bytes)).mode("append").save()


def index(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a package: key, file, offset, length, lines and sha256; a key's come by (file, offset)."""
    fs, base = store(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        listed = json.loads(f.read())["index"]
    if not listed:
        return spark.createDataFrame([], INDEX_DDL)
    return spark.read.schema(INDEX_DDL).parquet(*[f"{path}/{x}" for x in listed])


def _pieces(f, length: int) -> Iterator[bytes]:
    while length > 0:
        data = f.read(min(READ, length))
        if not data:
            return
        length -= len(data)
        yield data


def verified(spark: SparkSession, path: str) -> DataFrame:
    """SNK2: key, file, lines and state of each run: OK, FAIL (other bytes) or ERROR (missing). Files are read in pieces, and each is
    opened once by the task that checks its runs."""

    def run(batches):
        fs, base = store(path)
        schema = pa.schema([("key", pa.string()), ("file", pa.string()), ("lines", pa.int64()), ("state", pa.string())])
        name, f = None, None
        for batch in batches:
            states = []
            for file, offset, length, want in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "sha256"))):
                hash_ = hashlib.sha256()
                try:
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = None, None
                        f = fs.open_input_file(f"{base}/{file}")
                        name = file
                    f.seek(offset)
                    for data in _pieces(f, length):
                        hash_.update(data)
                    states.append("OK" if hash_.hexdigest() == want else "FAIL")
                except OSError:
                    states.append("ERROR")
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("file"), batch.column("lines"), pa.array(states, pa.string())], schema=schema)
        if f is not None:
            f.close()

    return index(spark, path).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, "key string, file string, lines long, state string")


def lines(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """key, file, offset, nth and line of a package, or of some ``keys`` (key): only their places are read."""

    def run(batches):
        fs, base = store(path)
        schema = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("nth", pa.int64()), ("line", pa.string())])
        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                nth, rest = 0, b""
                with fs.open_input_file(f"{base}/{file}") as f:
                    f.seek(offset)
                    for data in _pieces(f, length):
                        *whole, rest = (rest + data).split(b"\n")
                        if whole:
                            yield pa.RecordBatch.from_arrays([pa.array([key] * len(whole)), pa.array([file] * len(whole)), pa.array([offset] * len(whole), pa.int64()), pa.array(range(nth, nth + len(whole)), pa.int64()), pa.array([x.decode() for x in whole], pa.string())], schema=schema)
                            nth += len(whole)

    runs = index(spark, path)
    if keys is not None:
        runs = runs.join(keys.select(F.col("key").cast("string").alias("key")).distinct(), "key", "left_semi")
    return runs.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, "key string, file string, offset long, nth long, line string")
