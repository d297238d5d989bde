"""Digests of files of any size, as a Spark data source.

A read task gets whole files (small ones together) and reads each in pieces of
fixed size, so memory does not grow with a file.
"""

import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time, and bytes of the small files that share a task.
PIECE, TASK_BYTES = 1 << 20, 128 << 20
SCHEMA = "path string, name string, length long, sha256 string"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _digest(fs: pafs.FileSystem, path: str) -> tuple[int, str]:
    """Length and SHA-256 of a file, read in pieces."""
    sha, size = hashlib.sha256(), 0
    with fs.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(PIECE):
            sha.update(piece)
            size += len(piece)
    return size, sha.hexdigest()


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files  # path, name


class _Reader(DataSourceReader):
    def __init__(self, root: str, glob: str | None):
        self.root, self.glob = root, glob

    def partitions(self) -> list[InputPartition]:
        fs, root = _file_system(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = []
        for f in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            name = f.base_name if info.is_file else f.path[len(root):].lstrip("/")
            hidden = any(part[:1] in "._" for part in name.split("/"))
            if not hidden and (self.glob is None or fnmatch.fnmatch(f.base_name, self.glob)):
                files.append((f.path, name, f.size or 0))
        parts, held = [], 0
        for path, name, size in files:
            if not parts or held + size > TASK_BYTES:
                parts.append(_Files([]))
                held = 0
            parts[-1].files.append((path, name))
            held += size
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.root)
        for path, name in partition.files:
            size, sha = _digest(fs, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "name": [name], "length": [size], "sha256": [sha]})


class FileDigestSource(DataSource):
    """``spark.read.format("file_digests").load(path)``, option ``glob``."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("glob"))


def _pieces_readable(path: str) -> bool:
    """Whether ``pyarrow.fs`` knows the store of ``path``."""
    try:
        _file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def file_digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, name, length, sha256)`` of every file under ``path`` (a file or a
    folder with its subfolders; hidden files, which start with ``.`` or ``_``,
    do not count). The name is the path below ``path``.

    Files are read in pieces, so they may be of any size. A store that only
    Spark can read, not ``pyarrow.fs``, goes through ``binaryFile``, where one
    file must stay under 2 GB."""
    if not _pieces_readable(path):
        return listed_digests(spark, path, glob)
    spark.dataSource.register(FileDigestSource)
    reader = spark.read.format("file_digests")
    if glob:
        reader = reader.option("glob", glob)
    return reader.load(path)


def listed_digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The same columns of the files that Spark's whole-file reader lists. It
    only reads their content, whole, where ``pyarrow.fs`` does not know the
    store; else the tasks read it in pieces."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.expr("substring(path, %d)" % (len(root) + 2))
    name = F.when(F.col("path") == root, F.regexp_extract("path", r"([^/]+)$", 1)).otherwise(below).alias("name")
    found = reader.load(path)
    if not _pieces_readable(path):
        return found.select("path", name, "length", F.sha2(F.col("content"), 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _file_system(path)
        for b in batches:
            for at, called in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size, sha = _digest(fs, top if at == root else f"{top.rstrip('/')}/{called}")
                yield pa.RecordBatch.from_pydict({"path": [at], "name": [called], "length": [size], "sha256": [sha]})

    return found.select("path", name).mapInArrow(run, SCHEMA)
