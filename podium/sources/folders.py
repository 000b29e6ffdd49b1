"""Folders of files as a Python data source, and a content-addressed store as a sink of one.

Both work on folders that the driver and all executors have mounted: executors list and copy, each its own part.
"""

from __future__ import annotations

import json
import os
import shutil
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from ..operators.ranks import importable, placed

if TYPE_CHECKING:
    import pyarrow as pa


def mounted(path: str) -> str:
    """A path as the file system has it; a scheme that Python can't open is refused."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} isn't a mounted folder")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class Part(InputPartition):
    """One folder: its own files, or all below it."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    """Lists each folder of the first level as a partition of its own. Equality and lists on category (that folder) and suffix are applied before anything is listed or returned."""

    def __init__(self, root: str):
        self.root, self.category, self.suffix = root, None, None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, IsNotNull):  # no column of this source is ever null
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute in (("category",), ("suffix",)):
                name = f.attribute[0]
                had = getattr(self, name)
                setattr(self, name, wanted if had is None else had & wanted)
            else:
                yield f

    def partitions(self) -> list[Part]:
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)) if os.path.isdir(self.root) else []
        parts = [Part(t, True) for t in tops if self.category is None or t in self.category]
        return parts + [Part("", False)] * (self.category is None or "" in self.category)

    def read(self, part: Part) -> Iterator[tuple]:
        todo = [os.path.join(self.root, part.folder) if part.folder else self.root]
        while todo:
            at = todo.pop()
            if not os.path.isdir(at):
                continue
            for e in os.scandir(at):
                if e.is_dir(follow_symlinks=False):
                    todo += [e.path] * part.deep
                    continue
                suffix = os.path.splitext(e.name)[1]
                if self.suffix is not None and suffix not in self.suffix:
                    continue
                try:
                    s = e.stat()
                except FileNotFoundError:  # gone meanwhile
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield part.folder, e.path, e.name, suffix, s.st_size


class Folder(DataSource):
    """(category, path, name, suffix, length) of all regular files below option ``path``, empty ones too; category is the folder of the first level, empty for files beside it."""

    @classmethod
    def name(cls) -> str:
        return "podium_files"

    def schema(self) -> str:
        return "category string, path string, name string, suffix string, length long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(mounted(self.options["path"]))


def files(spark: SparkSession, root: str) -> DataFrame:
    importable(spark)
    spark.dataSource.register(Folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("podium_files").option("path", root).load()


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".cif", ".pdb")) -> DataFrame:
    """(path, length, place) of files with these suffixes, empty files too; the first suffix's files come first, then by path."""
    kind = F.array_position(F.array(*map(F.lit, suffixes)), F.col("suffix"))
    found = files(spark, root).where(F.col("suffix").isin(*suffixes)).select("path", "length", kind.alias("kind"), F.lit(0).alias("all"))
    return placed(found, ["all"], ["kind", "path"]).select("path", "length", "place")


def hashes(listed: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of listed paths, read by executors a piece at a time; what isn't there, or is no file, has no bytes and an empty hash.

    Only listed files are read, of any length; repeated paths give a row each, null ones none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import pyarrow as pa

        for b in batches:
            paths, sizes, digests = b["path"].to_pylist(), [], []
            for path in paths:
                digest, size = hashlib.sha256(), 0
                try:
                    with open(mounted(path), "rb") as f:
                        while piece := f.read(1 << 20):
                            digest.update(piece)
                            size += len(piece)
                except (FileNotFoundError, IsADirectoryError):
                    size = None
                sizes.append(size)
                digests.append("" if size is None else digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])

    importable(listed.sparkSession)
    return listed.where("path is not null").select("path").mapInArrow(work, "path string, bytes long, sha256 string")


# -- the store ----------------------------------------------------------------------------------


@dataclass
class Copied(WriterCommitMessage):
    copied: int
    present: int
    missing: int
    bytes: int


class StoreWriter(DataSourceWriter):
    """Files are copied beside the store under a name of their own and linked into place when whole, so that a killed task leaves nothing that looks like a file of the store."""

    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    @property
    def aside(self) -> str:
        return os.path.join(self.root, f"_copying-{self.job}")

    def write(self, rows) -> Copied:
        copied = present = missing = size = 0
        os.makedirs(self.aside, exist_ok=True)
        for row in rows:
            to = os.path.join(self.root, row["store_path"])
            if os.path.exists(to):
                present += 1
                continue
            half = os.path.join(self.aside, uuid.uuid4().hex)
            try:
                shutil.copyfile(mounted(row["source"]), half)
            except FileNotFoundError:
                missing += 1
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            try:
                os.link(half, to)  # fails where another task was first
                copied, size = copied + 1, size + os.path.getsize(half)
            except FileExistsError:
                present += 1
            os.unlink(half)
        return Copied(copied, present, missing, size)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        total = {k: sum(getattr(m, k) for m in done) for k in ("copied", "present", "missing", "bytes")}
        shutil.rmtree(self.aside, ignore_errors=True)
        with open(os.path.join(self.root, f"_copied-{self.job}.json"), "w") as out:
            json.dump(total, out)

    def abort(self, messages) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class Store(DataSource):
    """Rows (source, store_path) -> copies below option ``path``; what is there stays and isn't counted as bytes."""

    @classmethod
    def name(cls) -> str:
        return "podium_store"

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        root = mounted(self.options["path"])
        os.makedirs(root, exist_ok=True)
        return StoreWriter(root)


def store(rows: DataFrame, root: str) -> dict[str, int]:
    """Copies sources to store paths by the executors; returns how many were copied, were there, had no source, and the bytes copied."""
    importable(rows.sparkSession)
    rows.sparkSession.dataSource.register(Store)
    at = mounted(root)
    before = {n for n in os.listdir(at) if n.startswith("_copied-")} if os.path.isdir(at) else set()
    rows.where("source is not null and store_path is not null").select("source", "store_path").write.format("podium_store").option("path", root).mode("append").save()
    new = [n for n in os.listdir(at) if n.startswith("_copied-") and n not in before]
    with open(os.path.join(at, new[0])) as told:
        return json.load(told)
