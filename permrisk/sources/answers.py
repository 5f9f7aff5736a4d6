"""Stored answers of civic platforms as a data source of their own: batch and stream reader with pushed filters, and a sink.

A store is a folder. ``data/<batch>/*.jsonl`` holds answers, one JSON object a
line; ``batches/<batch>.json`` lists the files of a batch with their sizes, days,
platforms and sources, and is written last: what it does not list does not count,
so neither tasks tried twice nor batches broken off leave anything to be read.
Plans are made from these lists alone. Use::

    spark.dataSource.register(CivicAnswers)
    answers.write.format("civic_answers").option("path", p).option("batch", 7).mode("append").save()
    stored(spark, p, since="2024-01-01", platform=["legistar"])
    spark.readStream.format("civic_answers").option("path", p).load()

The options ``platform``, ``source`` (values parted by commas), ``since`` (least last
day) and ``until`` (greatest first day) choose files by the lists, and rows before
these go to Spark; ``stored`` sets them. With the option ``pushdown`` and
``spark.sql.python.filterPushdown.enabled`` Spark's own filters do so as well. That
is off by default: Spark 4.1.2 keeps one plan of the reader for all uses of a loaded
table, so a table with pushed filters may be filtered once only; load again for
another filter, or rows are missing.

Landing a batch that is there changes nothing. Answers may be null, empty or of any
length; a null meets no condition.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "platform string, source string, fetched_on date, first_day date, last_day date, answer string"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
DAYS = ("fetched_on", "first_day", "last_day")
#: a file is closed at this size; a task of the reader takes files up to this size together
FILE_BYTES = 64 << 20
#: a file of more different values than this is not ruled out by platform or source
LISTED = 256


def _store(path: str) -> tuple[filesystems.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return filesystems.FileSystem.from_uri(path) if "://" in path else (filesystems.LocalFileSystem(), path)


@dataclass(frozen=True)
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Landed(WriterCommitMessage):
    files: tuple[dict, ...]


#: the filters a reader takes over
KINDS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass(frozen=True)
class Condition:
    """A filter that the reader answers in full: on the values of a row, and on what a list says of a file. Nulls meet none."""

    column: str
    kind: str
    value: object

    @classmethod
    def of(cls, f: Filter) -> Condition | None:
        column, kind = ".".join(getattr(f, "attribute", ())), KINDS.get(type(f))
        named = column in ("platform", "source") and kind in ("=", "in")
        if not named and not (column in DAYS and kind not in (None, "in")):
            return None
        value = f.value.isoformat() if column in DAYS else frozenset(f.value if kind == "in" else [f.value]) - {None}
        return cls(column, kind, value)

    def met(self, row: dict) -> bool:
        got = row[self.column]
        if got is None:
            return False
        if self.column not in DAYS:
            return got in self.value
        return {"=": got == self.value, ">": got > self.value, ">=": got >= self.value, "<": got < self.value, "<=": got <= self.value}[self.kind]

    def possible(self, entry: dict) -> bool:
        """May a row of the file meet it."""
        if self.column not in DAYS:
            return entry[self.column] is None or bool(self.value & set(entry[self.column]))
        low, high = entry["low"][self.column], entry["high"][self.column]
        return low is not None and not ((self.kind in ("=", ">", ">=") and high < self.value) or (self.kind in ("=", "<", "<=") and low > self.value))


def chosen(options: Mapping[str, str]) -> list[Condition]:
    """The conditions that options state."""
    found = [Condition(c, "in", frozenset(options[c].split(","))) for c in ("platform", "source") if options.get(c)]
    found += [Condition(c, kind, dt.date.fromisoformat(options[o]).isoformat()) for o, c, kind in (("since", "last_day", ">="), ("until", "first_day", "<=")) if options.get(o)]
    return found


def _batches(path: str) -> list[int]:
    where, root = _store(path)
    found = where.get_file_info(filesystems.FileSelector(f"{root}/batches", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def _packed(path: str, batches: Iterable[int], conditions: Sequence[Condition] = ()) -> list[Files]:
    """The files of these batches whose rows may meet all conditions, some together up to FILE_BYTES."""
    where, root = _store(path)
    packs: list[Files] = []
    names: list[str] = []
    size = 0
    for batch in batches:
        with where.open_input_stream(f"{root}/batches/{batch:012d}.json") as lines:
            listed = json.loads(lines.read())
        for entry in (e for e in listed if all(c.possible(e) for c in conditions)):
            if names and size + entry["bytes"] > FILE_BYTES:
                packs.append(Files(tuple(names)))
                names, size = [], 0
            names.append(entry["file"])
            size += entry["bytes"]
    return [*packs, Files(tuple(names))] if names else packs


def _rows(path: str, files: Files, conditions: Sequence[Condition] = ()) -> Iterator[tuple]:
    where, root = _store(path)
    for name in files.names:
        with where.open_input_stream(f"{root}/{name}") as raw:
            for line in io.BufferedReader(raw, 1 << 20):
                got = json.loads(line)
                if all(c.met(got) for c in conditions):
                    yield tuple(dt.date.fromisoformat(got[n]) if n in DAYS and got[n] else got[n] for n in NAMES)


class AnswerReader(DataSourceReader):
    def __init__(self, path: str, conditions: Sequence[Condition] = ()):
        self.path, self.conditions = path, list(conditions)

    def partitions(self) -> list[Files]:
        # a plan without any task is one that reads nothing
        return _packed(self.path, _batches(self.path), self.conditions) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition, self.conditions)


class PushedReader(AnswerReader):
    """One that takes over what filters it can; Spark keeps the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            condition = Condition.of(f)
            if condition is None:
                yield f
            else:
                self.conditions.append(condition)


class AnswerStream(DataSourceStreamReader):
    """An offset is the last batch that counts; a trigger reads the batches between two of them.

    Batches are landed in the order of their numbers: one that is landed after a
    later one was read is not seen by streams under way.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_batches(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _packed(self.path, [b for b in _batches(self.path) if start["batch"] < b <= end["batch"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _Open:
    """One file that is being written, and what the list of its batch will say of it."""

    def __init__(self, where: filesystems.FileSystem, root: str, batch: int):
        self.name = f"data/{batch:012d}/{uuid.uuid4().hex}.jsonl"
        where.create_dir(f"{root}/data/{batch:012d}", recursive=True)
        self.out, self.size, self.n = where.open_output_stream(f"{root}/{self.name}"), 0, 0
        self.seen: dict[str, set] = {"platform": set(), "source": set()}
        self.low: dict[str, str | None] = dict.fromkeys(DAYS)
        self.high: dict[str, str | None] = dict.fromkeys(DAYS)

    def add(self, row: Row) -> None:
        got = {n: row[n].isoformat() if n in DAYS and row[n] is not None else row[n] for n in NAMES}
        line = json.dumps(got, separators=(",", ":")).encode() + b"\n"
        self.out.write(line)
        self.size, self.n = self.size + len(line), self.n + 1
        for column, values in self.seen.items():
            if len(values) <= LISTED and got[column] is not None:
                values.add(got[column])
        for day in DAYS:
            self.low[day] = min(filter(None, (self.low[day], got[day])), default=None)
            self.high[day] = max(filter(None, (self.high[day], got[day])), default=None)

    def close(self) -> dict:
        self.out.close()
        listed = {c: sorted(v) if len(v) <= LISTED else None for c, v in self.seen.items()}
        return {"file": self.name, "bytes": self.size, "rows": self.n, "low": self.low, "high": self.high, **listed}


class AnswerWriter(DataSourceWriter):
    def __init__(self, path: str, batch: int, overwrite: bool):
        if overwrite:
            raise ValueError("a store of answers is only appended to")
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[Row]) -> Landed:
        where, root = _store(self.path)
        done, now = [], None
        for row in iterator:
            now = now or _Open(where, root, self.batch)
            now.add(row)
            if now.size >= FILE_BYTES:
                done.append(now.close())
                now = None
        return Landed((*done, now.close()) if now else tuple(done))

    def commit(self, messages: list[Landed | None]) -> None:
        where, root = _store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if self.batch in _batches(self.path):
            return self._drop(files)
        where.create_dir(f"{root}/batches", recursive=True)
        with where.open_output_stream(f"{root}/batches/{self.batch:012d}.part") as out:
            out.write(json.dumps(files).encode())
        where.move(f"{root}/batches/{self.batch:012d}.part", f"{root}/batches/{self.batch:012d}.json")

    def abort(self, messages: list[Landed | None]) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])

    def _drop(self, files: list[dict]) -> None:
        where, root = _store(self.path)
        for f in files:
            where.delete_file(f"{root}/{f['file']}")


class CivicAnswers(DataSource):
    """Options: ``path``, and for writing ``batch``, the number of the batch."""

    @classmethod
    def name(cls) -> str:
        return "civic_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswerReader:
        reader = PushedReader if self.options.get("pushdown", "false").lower() == "true" else AnswerReader
        return reader(self.options["path"], chosen(self.options))

    def streamReader(self, schema) -> AnswerStream:
        return AnswerStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> AnswerWriter:
        return AnswerWriter(self.options["path"], int(self.options["batch"]), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(CivicAnswers)


def stored(spark: SparkSession, path: str, platform: Sequence[str] = (), source: Sequence[str] = (), since: str = "", until: str = "") -> DataFrame:
    """The answers of a store that meet all that is given."""
    given = {"platform": ",".join(platform), "source": ",".join(source), "since": since, "until": until}
    return spark.read.format("civic_answers").options(path=path, **{k: v for k, v in given.items() if v}).load()
