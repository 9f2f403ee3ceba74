"""Sinks and file sources for documents and other text."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from linkatlas.functions.text import HASHES
from linkatlas.session import durable

# Folders that a task lists in the first round of a listing, and how many times as many in each further one; paths in a batch of it; bytes read at once, and in a batch of contents.
FOLDERS, MORE = 1000, 10
PATHS, BLOCK, BATCH = 10_000, 1 << 20, 8 << 20


def write_documents(documents: DataFrame, path: str) -> None:
    """``(path, body)`` rows as a Parquet table, split by path whatever the folder sizes."""
    documents.select("path", "body").repartition("path").write.mode("errorifexists").parquet(path)


class DocumentSink(DataSource):
    """``df.write.format("documents").option("root", folder)``: one file for each row ``(path, body)``, all of them or none."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or "root" not in self.options:
            raise ValueError("documents are appended to a new folder, which the option root names")
        return DocumentWriter(self.options["root"], schema.names.index("path"), schema.names.index("body"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class DocumentWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job's own, on a file system that Arrow reaches from every executor under the same URI. The job's commit gives that folder its
    name in one step, and an abort removes it, so readers see no part of a job. A task that runs again writes the same files over."""

    def __init__(self, root: str, path_at: int, body_at: int):
        self.root, self.staging, self.path_at, self.body_at = root.rstrip("/"), f"{root.rstrip('/')}.{uuid.uuid4().hex}", path_at, body_at

    def _open(self, uri: str):
        return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = self._open(self.staging)
        count = 0
        for batch in iterator:
            for name, body in zip(batch.column(self.path_at).to_pylist(), batch.column(self.body_at).to_pylist()):
                inside = posixpath.normpath(name.lstrip("/"))
                if inside in (".", "..") or inside.startswith("../"):
                    raise ValueError(f"path outside the folder: {name}")
                target = f"{base}/{inside}"
                files.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(body.encode())
                files.move(part, target)
                count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = self._open(self.staging)
        root = self._open(self.root)[1]
        if files.get_file_info(root).type != FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.root} is there already")
        files.create_dir(base, recursive=True)
        files.move(base, root)

    def abort(self, messages: list[Written | None]) -> None:
        files, base = self._open(self.staging)
        if files.get_file_info(base).type != FileType.NotFound:
            files.delete_dir(base)


def write_document_files(documents: DataFrame, root: str) -> None:
    """One file per row below ``root``, a folder that must not be there yet; see ``DocumentSink``. For exports whose number of files a file system bears."""
    documents.sparkSession.dataSource.register(DocumentSink)
    documents.select("path", "body").write.format("documents").mode("append").option("root", root).save()


def write_outline(fenced: DataFrame, path: str) -> None:
    """Fenced outlines as text files, one folder per export."""
    fenced.select("export_id", "document").write.partitionBy("export_id").mode("errorifexists").text(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows of Spark's own reader. It keeps the list of all files in the driver."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _folder(spark: SparkSession, path: str) -> tuple[str, str, str] | None:
    """A folder that Arrow reaches: its path as Spark spells it, as a URI, and inside the file system. None for all else: patterns, single files, what is not there, file systems of Spark's own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    named = hadoop.Path(path)
    named = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named)
    uri = named.toUri().toString()
    try:
        files, base = FileSystem.from_uri(uri)
        found = files.get_file_info(base).type
    except (OSError, ValueError):
        return None
    return (named.toString(), uri, base) if found == FileType.Directory else None


def _passed_over(entry: FileInfo) -> bool:
    """What Spark's readers leave out: names of the kind of ``_SUCCESS`` and ``.x``, and empty files."""
    name, folder = entry.base_name, entry.type == FileType.Directory
    kept = "=" in name or (folder and name.startswith(("_metadata", "_common_metadata")))
    return name.startswith(".") or (name.startswith("_") and not kept) or name.endswith("._COPYING_") or not (folder or entry.size)


def _paths(spark: SparkSession, uri: str, base: str, every: bool) -> DataFrame:
    """``path`` of every file below the folder ``base``, found by the tasks and never gathered in the driver.

    A task goes down from its folders; after so many it hands on those that are left, and the next round deals them out anew. So a tree of any shape is shared
    by all tasks, in few rounds. The entries of one folder are listed at once.
    """
    def walk(most: int):
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, found, left, done = FileSystem.from_uri(uri)[0], [], [], 0
            rows = lambda paths, folder: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([folder] * len(paths), pa.bool_())], ["path", "folder"])
            for batch in batches:
                for top in batch.column(0).to_pylist():
                    left.append(top)
                    while left and done < most:
                        done += 1
                        for entry in files.get_file_info(FileSelector(left.pop())):
                            if entry.type != FileType.NotFound and (every or not _passed_over(entry)):
                                (left if entry.type == FileType.Directory else found).append(entry.path)
                        if len(found) >= PATHS:
                            yield rows(found, False)
                            found = []
                    if len(left) >= PATHS:
                        yield rows(left, True)
                        left = []
            yield rows(found, False)
            yield rows(left, True)
        return listed

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, most, rounds = spark.createDataFrame([(base,)], "path string"), FOLDERS, []
    while not rounds or not folders.isEmpty():
        found = durable(folders.repartition(count, "path").mapInArrow(walk(most), "path string, folder boolean"))
        rounds.append(found.filter(~F.col("folder")).select("path"))
        folders, most = found.filter("folder").select("path"), most * MORE
    return reduce(DataFrame.unionByName, rounds).repartition(count, "path")


def _spelled(root: str, base: str) -> Column:
    """A path inside the file system as Spark spells it."""
    return F.concat(F.lit(root.rstrip("/")), F.substr("path", F.lit(len(base.rstrip("/")) + 1)))


def file_contents(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """``path`` and ``content`` of every file below ``path``; a file must fit in a row (2 GB). ``every``: also of those that Spark's readers leave out, see ``_passed_over``."""
    folder = _folder(spark, path)
    if folder is None:
        return _whole(spark, path).select("path", "content")
    root, uri, base = folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSystem.from_uri(uri)[0]
        rows = lambda names, contents: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        for batch in batches:
            names, contents, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(name) as opened:
                    content = opened.read()
                if names and size + len(content) > BATCH:
                    yield rows(names, contents)
                    names, contents, size = [], [], 0
                names.append(name)
                contents.append(content)
                size += len(content)
            yield rows(names, contents)

    return _paths(spark, uri, base, every).mapInArrow(read, "path string, content binary").select(_spelled(root, base).alias("path"), "content")


def file_hashes(spark: SparkSession, path: str, algorithm: str = "md5", every: bool = False) -> DataFrame:
    """Fingerprint of every file below ``path``, of any size. ``every``: also of those that Spark's readers leave out, see ``_passed_over``."""
    if algorithm not in HASHES:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    folder = _folder(spark, path)
    if folder is None:
        return _whole(spark, path).select("path", HASHES[algorithm](F.col("content")).alias("hash"))
    root, uri, base = folder

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSystem.from_uri(uri)[0]
        for batch in batches:
            hashes = []
            for name in batch.column(0).to_pylist():
                made = hashlib.new(algorithm, usedforsecurity=False)
                with files.open_input_stream(name) as opened:
                    while block := opened.read(BLOCK):
                        made.update(block)
                hashes.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], ["path", "hash"])

    return _paths(spark, uri, base, every).mapInArrow(hashed, "path string, hash string").select(_spelled(root, base).alias("path"), "hash")
