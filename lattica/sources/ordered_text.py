"""A text data source whose lines keep their order: one ordered result, written and read by many tasks.

A table is a folder of part files and a manifest ``_lines.json``, which names the parts in order, with the first line
and the byte offset of every stretch of about SPLIT_BYTES.  The manifest is replaced by a rename after all tasks are done, so readers see the old lines or
the new ones.  A task that fails deletes its own part, a job that fails all parts of the job; parts of attempts that Spark
didn't commit go when the job is committed.  Reading plans a task a stretch, and each line comes with its number;
a range of lines plans only the stretches that hold some of them.

The parts are plain text (UTF-8, a value a line, no header, quoting or escapes), so ``spark.read.text`` reads them, too.  A null
is an empty line; a value that holds a line break can't be a line, and the job fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_lines.json"
#: Bytes of a stretch, which is one task of a reading: the manifest has an entry each.
SPLIT_BYTES = 128 << 20
#: Bytes of a read, rows of a write.
_CHUNK, _ROWS = 4 << 20, 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _manifest(folder: str) -> list[dict] | None:
    """The parts in order; None where nothing has been written."""
    system, local = _open(folder)
    if system.get_file_info(f"{local}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{local}/{MANIFEST}", compression=None) as file:
        return json.loads(file.read())


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its file, and (byte offset, lines before it in this file) of each stretch."""

    partition: int
    name: str
    lines: int
    bytes: int
    stretches: list[tuple[int, int]]


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int
    first: int


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, split: int):
        self.folder, self.overwrite, self.split, self.job = folder, overwrite, split, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        partition = TaskContext.get().partitionId()
        part = Part(partition, f"part-{partition:06d}-{self.job}-{uuid.uuid4().hex}.txt", 0, 0, [])
        system, local = _open(self.folder)
        system.create_dir(local, recursive=True)
        path = f"{local}/{part.name}"
        try:
            with system.open_output_stream(path, compression=None) as out:
                for batch in iterator:
                    for at in range(0, batch.num_rows, _ROWS):
                        self._append(part, batch.column(0).slice(at, _ROWS), out)
        except BaseException:
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)
            raise
        if not part.lines:
            system.delete_file(path)
        return part

    def _append(self, part: Part, values: pa.Array, out) -> None:
        if pc.any(pc.match_substring_regex(values, "[\r\n]")).as_py():
            raise ValueError("a value that holds a line break can't be a line")
        if not part.stretches or part.bytes - part.stretches[-1][0] >= self.split:
            part.stretches.append((part.bytes, part.lines))
        raw = "".join(f"{v}\n" for v in pc.fill_null(values, "").to_pylist()).encode()
        out.write(raw)
        part.bytes += len(raw)
        part.lines += len(values)

    def commit(self, messages: list[Part | None]) -> None:
        system, local = _open(self.folder)
        before = _manifest(self.folder) or []
        new = [{"name": m.name, "lines": m.lines, "bytes": m.bytes, "stretches": m.stretches} for m in sorted((m for m in messages if m and m.lines), key=lambda m: m.partition)]
        system.create_dir(local, recursive=True)
        with system.open_output_stream(f"{local}/_{self.job}.json", compression=None) as out:
            out.write(json.dumps(new if self.overwrite else before + new).encode())
        system.move(f"{local}/_{self.job}.json", f"{local}/{MANIFEST}")
        self._delete({p["name"] for p in before} if self.overwrite else set(), {p["name"] for p in new})

    def abort(self, messages: list[Part | None]) -> None:
        self._delete(set(), set())

    def _delete(self, names: set[str], keep: set[str]) -> None:
        """Delete the named parts and those of this job, but for those to keep."""
        system, local = _open(self.folder)
        for info in system.get_file_info(fs.FileSelector(local, allow_not_found=True)):
            if info.base_name not in keep and (info.base_name in names or self.job in info.base_name):
                system.delete_file(info.path)


class Reader(DataSourceReader):
    def __init__(self, folder: str, first: int, last: int | None):
        self.folder, self.first, self.last = folder, first, last

    def partitions(self) -> list[Stretch]:
        parts = _manifest(self.folder)
        if parts is None:
            raise FileNotFoundError(f"no {MANIFEST} in {self.folder}")
        found, before = [], 0
        for part in parts:
            cuts = part["stretches"] + [(part["bytes"], part["lines"])]
            for (start, line), (end, line_end) in zip(cuts, cuts[1:]):
                if before + line_end > self.first and (self.last is None or before + line <= self.last):
                    found.append(Stretch(f"{self.folder}/{part['name']}", start, end, before + line))
            before += part["lines"]
        return found

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        system, local = _open(partition.path)
        at, line, rest = partition.start, partition.first, b""
        with system.open_input_file(local) as file:
            while at < partition.end:
                raw = file.read_at(min(_CHUNK, partition.end - at), at)
                if not raw:
                    raise EOFError(f"{partition.path} ends at {at}, before {partition.end}")
                at += len(raw)
                *whole, rest = (rest + raw).split(b"\n")
                numbers = range(line, line + len(whole))
                line += len(whole)
                a, b = max(0, self.first - numbers.start), len(whole) if self.last is None else max(0, self.last + 1 - numbers.start)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[a:b], pa.int64()), pa.array([v.decode() for v in whole[a:b]], pa.string())], ["line", "value"])


class OrderedText(DataSource):
    """Options: ``path``; reading: ``first`` and ``last`` line, from 0, both included; writing: ``split`` bytes of a stretch."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        return "line long, value string"

    def reader(self, schema: StructType) -> Reader:
        last = self.options.get("last")
        return Reader(self.options["path"].rstrip("/"), int(self.options.get("first", 0)), None if last is None else int(last))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if len(schema) != 1 or schema[0].dataType.typeName() != "string":
            raise ValueError("ordered_text takes one column of strings")
        return Writer(self.options["path"].rstrip("/"), overwrite, int(self.options.get("split", SPLIT_BYTES)))


def write_lines(df: DataFrame, path: str, order: list[Column | str], columns: list[str], mode: str = "overwrite", split: int = SPLIT_BYTES) -> None:
    """The columns of each row, with ", " between, as a line, in the given order; ``mode`` append puts the lines after those there are."""
    df.sparkSession.dataSource.register(OrderedText)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    df.orderBy(*order).select(F.concat_ws(", ", *fields).alias("value")).write.format("ordered_text").option("split", split).mode(mode).save(path)


def read_lines(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(line, value) of the lines from ``first`` to ``last``, both included."""
    spark.dataSource.register(OrderedText)
    found = spark.read.format("ordered_text").option("first", first)
    return (found if last is None else found.option("last", last)).load(path)
