"""Python data sources for files that Spark's own sources cannot read.

``file_digests`` gives one row per file with its size, first bytes and SHA-256.
``packed_lines`` gives the lines of Zstandard files. ``whole_digests`` hashes
listed files a second way. All read in chunks, so a task holds a chunk of a
file and not the file, whatever its size. Files are opened by URI through
``pyarrow.fs`` where the task runs, so the store must be one that it knows
(local paths, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 8 << 20
HEAD = 4
# Small files share a task up to this size.
TASK_BYTES = 128 << 20
LINES_AT_ONCE = 4096


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(uri.rstrip("/"))


def list_files(root: str, directories=("",)) -> list[tuple[str, int]]:
    """(path below the root, bytes) of all files below the directories; only names that begin with a dot are left out."""
    store, base = open_store(root)
    found = {}
    for directory in directories:
        selector = pafs.FileSelector(f"{base}/{directory}".rstrip("/"), recursive=True)
        for info in store.get_file_info(selector):
            if info.type == pafs.FileType.File and not info.base_name.startswith("."):
                found[info.path[len(base.rstrip("/")) + 1 :]] = info.size
    return sorted(found.items())


def chunks_of(stream, size: int) -> Iterator[bytes]:
    while piece := stream.read(size):
        yield piece


def digest_of(stream, size: int = CHUNK) -> tuple[int, bytes, str]:
    """Bytes read, first bytes and SHA-256 of a stream, chunk by chunk."""
    sha, n, head = hashlib.sha256(), 0, b""
    for piece in chunks_of(stream, size):
        sha.update(piece)
        n += len(piece)
        head += piece[: HEAD - len(head)]
    return n, head, sha.hexdigest()


def lines_of(stream, size: int = CHUNK) -> Iterator[str]:
    """Lines of a stream without their ends; holds a chunk and one line."""
    rest = b""
    for piece in chunks_of(stream, size):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode()
    if rest:
        yield rest.decode()


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def by_size(files: list[tuple[str, int]], most: int = TASK_BYTES) -> list[list[str]]:
    """Runs of files of at most ``most`` bytes; a larger file is a run of its own."""
    runs: list[list[str]] = []
    room = 0
    for path, size in files:
        if not runs or size > room:
            runs.append([])
            room = most
        runs[-1].append(path)
        room -= size
    return runs


class DigestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.directories = options["root"], json.loads(options["directories"])
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self):
        return [Paths(run) for run in by_size(list_files(self.root, self.directories))]

    def read(self, partition: Paths):
        store, base = open_store(self.root)
        for path in partition.paths:
            with store.open_input_stream(f"{base.rstrip('/')}/{path}", buffer_size=0) as stream:
                yield (path, *digest_of(stream, self.chunk))


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes bigint, head binary, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(dict(self.options))


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.paths = options["root"], json.loads(options["paths"])
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self):
        return [Paths([path]) for path in self.paths]

    def read(self, partition: Paths):
        store, base = open_store(self.root)
        for path in partition.paths:
            with store.open_input_stream(f"{base.rstrip('/')}/{path}", compression="zstd") as stream:
                held: list[str] = []
                for line in lines_of(stream, self.chunk):
                    held.append(line)
                    if len(held) == LINES_AT_ONCE:
                        yield self.batch(path, held)
                        held = []
                yield self.batch(path, held)

    @staticmethod
    def batch(path: str, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([path] * len(lines), pa.string()), "value": pa.array(lines, pa.string())})


class PackedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_lines"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(dict(self.options))


def file_digests(spark: SparkSession, root: str, directories=("",), chunk: int = CHUNK) -> DataFrame:
    """(path, bytes, head, sha256) of every file below the directories."""
    spark.dataSource.register(FileDigests)
    options = {"root": root, "directories": json.dumps(list(directories)), "chunk": str(chunk)}
    return spark.read.format("file_digests").options(**options).load()


def whole_digests(listed: DataFrame, root: str) -> DataFrame:
    """Listed files of a folder (filename, length) with the SHA-256 of their contents (digest).

    No reading code is shared with ``file_digests``: files are opened for random access and ``hashlib`` reads them by a loop of its own.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for batch in batches:
            found = []
            for name in batch.column("filename").to_pylist():
                with store.open_input_file(f"{base.rstrip('/')}/{name}") as file:
                    found.append(hashlib.file_digest(file, "sha256").hexdigest())
            yield batch.append_column("digest", pa.array(found, pa.string()))

    return listed.mapInArrow(digests, "filename string, length bigint, digest string")


def packed_lines(spark: SparkSession, root: str, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """(path, value) lines of Zstandard files, given by their paths below the root."""
    spark.dataSource.register(PackedLines)
    return spark.read.format("packed_lines").options(root=root, paths=json.dumps(paths), chunk=str(chunk)).load()
