"""Zip archives as a data source: the members of archives are planned as partitions, and a member's lines are streamed.

An archive's directory is read when the scan is planned, a member's bytes only by the task that has its partition. Paths are local
or shared folders and the stores that pyarrow opens; a member is unpacked by one task, as its format allows no cut.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines in a batch; archives whose directories are read at the same time.
BATCH, OPENED = 8192, 16


def _store(path: str):
    """(file system, path inside of it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Member(InputPartition):
    archive: str
    name: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.encoding, self.first = options["path"], options.get("encoding", "UTF-8"), options.get("first", "false") == "true"

    def partitions(self) -> list[Member]:
        from pyarrow import fs

        store, at = _store(self.path)
        found = store.get_file_info(at)
        listed = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        names = sorted(f.path for f in listed if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))

        def members(name: str) -> list[Member]:
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                own = [m.filename for m in z.infolist() if not m.is_dir()]
            return [Member(name, m) for m in (own[:1] if self.first else own)]

        with ThreadPoolExecutor(OPENED) as pool:
            return [m for found in pool.map(members, names) for m in found]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without members
            return
        store, _ = _store(self.path)
        file = partition.archive.rsplit("/", 1)[-1]
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            held, at = [], 0
            for line in io.TextIOWrapper(raw, self.encoding, newline=None):
                held.append(line.rstrip("\n"))
                if len(held) == BATCH:
                    yield self._batch(file, partition.name, at, held)
                    held, at = [], at + BATCH
            if held:
                yield self._batch(file, partition.name, at, held)

    @staticmethod
    def _batch(file: str, member: str, at: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([member] * n), pa.array(range(at, at + n), pa.int64()), pa.array(lines)], ["file", "member", "number", "value"])


class ZippedLines(DataSource):
    """Options: path, a folder or an archive; encoding; first: only the first member of each archive."""

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "file string, member string, number long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def zipped_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", first: bool = False) -> DataFrame:
    """(file, member, number, value): the lines of all members, or of the first member, of every archive; number from 0. Empty members have no line."""
    spark.dataSource.register(ZippedLines)
    return spark.read.format("zipped_lines").option("encoding", encoding).option("first", str(first).lower()).load(path)


def write_zips(rows: DataFrame, path: str, order: str, head: str | None = None, encoding: str = "UTF-8") -> None:
    """rows (file, member, order, value) as archives below path: the lines of a member by `order`, behind a head line of its own.

    An archive is written by one task, as its format wants, line by line from sorted rows; so archives should be many. It
    comes under its name only when it is whole, and a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        open_: list = []  # archive name, stream, archive, member name, member

        def shut(keep: int) -> None:
            while len(open_) > keep:
                name, thing = open_.pop()
                thing.close()
                if not open_:
                    stream.close()
                    store.move(f"{at}/_{name}", f"{at}/{name}")

        n = 0
        for batch in batches:
            for file, member, value in zip(*(batch.column(c).to_pylist() for c in ("file", "member", "value")), strict=True):
                if open_ and open_[0][0] != file:
                    shut(0)
                if not open_:
                    stream = store.open_output_stream(f"{at}/_{file}")
                    open_.append((file, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)))
                if len(open_) > 1 and open_[1][0] != member:
                    shut(1)
                if len(open_) == 1:
                    open_.append((member, open_[0][1].open(member, "w", force_zip64=True)))
                    if head is not None:
                        open_[1][1].write(f"{head}\r\n".encode(encoding))
                open_[1][1].write(f"{value or ''}\r\n".encode(encoding))
                n += 1
        shut(0)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    sorted_ = rows.select("file", "member", F.col(order).alias("__order"), "value").repartition("file").sortWithinPartitions("file", "member", "__order")
    sorted_.mapInArrow(run, "n long").agg(F.sum("n")).collect()
