"""A stream source that follows growing files of lines: its offsets are places in bytes, a file each."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestore.staging import qualified

#: Bytes looked through at once, more while a line is longer; bytes of a file that a batch goes on by; bytes of a task.
CHUNK, A_BATCH, A_TASK = 1 << 20, 64 << 20, 32 << 20
#: Lines of a record batch.
LINES = 10_000
_START = {"at": 0, "turn": 0, "stop": False}
_VERSION = re.compile(rb'"v"\s*:\s*([0-9][0-9.eE+-]*)')


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in [start, stop), cut out of [first, last) of whole lines."""

    file: str
    start: int
    stop: int
    first: int
    last: int


def newer(block: bytes, version: int) -> int | None:
    """Where in whole lines the first begins that is an object of a newer version."""
    for m in _VERSION.finditer(block):
        try:
            if float(m[1]) <= version:
                continue
            begin = block.rfind(b"\n", 0, m.start()) + 1
            row = json.loads(block[begin : block.find(b"\n", begin)])
        except ValueError:
            continue
        if isinstance(row, dict) and isinstance(row.get("v"), int | float) and not isinstance(row["v"], bool) and row["v"] > version:
            return begin
    return None


def advanced(where: fs.FileSystem, path: str, mark: dict, size: int, version: int, most: int | None) -> dict:
    """The mark as far on as the file has whole lines of this version, by about `most` bytes at most.

    A last line without its end waits. A file shorter than its mark begins a new turn at its first byte.
    """
    if size < mark["at"]:
        mark = _START | {"turn": mark["turn"] + 1}
    at, held = mark["at"], b""
    if at < size:
        with where.open_input_file(path) as f:
            place = at
            while place < size and (most is None or at - mark["at"] < most):
                f.seek(place)
                chunk = f.read(min(max(CHUNK, 3 * len(held)), size - place))
                if not chunk:
                    break
                place += len(chunk)
                held += chunk
                cut = held.rfind(b"\n") + 1
                stop = newer(held[:cut], version)
                if stop is not None:
                    return {"at": at + stop, "turn": mark["turn"], "stop": True}
                at, held = at + cut, held[cut:]
    return {"at": at, "turn": mark["turn"], "stop": False}


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.version = options["path"], int(options["version"])
        self.most, self.cursor = int(options.get("bytesPerTrigger", A_BATCH)), options.get("cursor")
        self.marks: dict[str, dict] | None = None

    def _files(self) -> list[fs.FileInfo]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def _remembered(self) -> dict:
        if not self.cursor:
            return {}
        where, path = fs.FileSystem.from_uri(self.cursor)
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with where.open_input_file(path) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Marks of all files. The first call goes to their ends, so that no mark lies before one of an earlier run; later ones go on by bytesPerTrigger."""
        first = self.marks is None
        marks = self._remembered() if first else self.marks
        where, _ = fs.FileSystem.from_uri(self.path)
        seen = {f.base_name: advanced(where, f.path, marks.get(f.base_name, _START), f.size, self.version, None if first else self.most) for f in self._files()}
        gone = {name: m if not m["at"] else _START | {"turn": m["turn"] + 1} for name, m in marks.items() if name not in seen}
        self.marks = dict(sorted((gone | seen).items()))
        return self.marks

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for name, to in sorted(end.items()):
            since = start.get(name, _START)
            a = since["at"] if since["turn"] == to["turn"] and since["at"] <= to["at"] else 0
            parts += [Stretch(name, x, min(x + A_TASK, to["at"]), a, to["at"]) for x in range(a, to["at"], A_TASK)]
            if to["stop"] and not (since["stop"] and since == to):
                parts.append(Stretch(name, to["at"], to["at"] + 1, to["at"], -1))
        return parts

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(self.path)
        rows: list[tuple[str, int, str]] = []
        with where.open_input_file(f"{root}/{part.file}") as f:
            for at, line in lines(f, part):
                if line.strip():
                    rows.append((part.file, at, line.decode("utf-8", "replace")))
                if len(rows) >= LINES:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    def commit(self, end: dict) -> None:
        if self.cursor:
            where, path = fs.FileSystem.from_uri(self.cursor)
            with where.open_output_stream(path + ".new") as f:
                f.write(json.dumps(end).encode())
            where.move(path + ".new", path)


def lines(f, part: Stretch) -> Iterator[tuple[int, bytes]]:
    """The stretch's lines and where they begin. One that goes on past it is its own, the one that it begins inside isn't."""
    last = part.last if part.last >= 0 else f.size()
    place = part.start - 1 if part.start > part.first else part.start
    at, held, skip = place, b"", part.start > part.first
    while at < part.stop and (place < last or held):
        f.seek(place)
        chunk = f.read(min(max(CHUNK, 3 * len(held)), last - place))
        if not chunk:
            return
        place += len(chunk)
        held += chunk
        *whole, held = held.split(b"\n")
        for line in whole:
            if at >= part.stop:
                return
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    file, at, value = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(value, pa.string())], names=["file", "byte", "value"])


class SpoolTail(DataSource):
    """Lines of the files in a folder, those appended later too: (file, byte, value).

    Options: path; version, the newest format this reader knows: a file's lines are read up to the first object with a
    larger `v`, which comes once, alone, to be counted, and the rest waits for a reader that knows it, on the same
    checkpoint or another; bytesPerTrigger, how far a file goes on in a batch; cursor, a file that remembers marks, so
    that a restart doesn't look through what is done.

    A file that is cut shorter is read again from its start. Only bytes that are new are looked at on the driver, for
    line ends and versions, a chunk at a time; lines are read in tasks, of A_TASK bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "spool_tail"

    def schema(self) -> str:
        return "file string, byte long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(dict(self.options))


def read_tail(spark: SparkSession, path: str, version: int, cursor: str | None = None, bytes_a_trigger: int = A_BATCH) -> DataFrame:
    """The stream of a spool's lines."""
    spark.dataSource.register(SpoolTail)
    t = spark.readStream.format("spool_tail").option("path", qualified(spark, path)).option("version", version).option("bytesPerTrigger", bytes_a_trigger)
    return (t.option("cursor", qualified(spark, cursor)) if cursor else t).load()
