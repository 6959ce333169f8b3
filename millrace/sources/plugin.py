"""Landing folders as Spark data sources, batch and stream, that take predicates.

    spark.read.format("millrace_mail").load(path)    message resources
    spark.read.format("millrace_board").load(path)   pages of job boards

Files lie below ``path`` in folders of one value each, ``sender=.../day=...`` for
mails and ``source_id=.../adapter=.../day=...`` for boards, one JSON value a line.
Equality, lists and lower bounds on those columns and on the time of a row are
taken over from the query: they choose folders and files before anything is
opened, and the reader drops what is left of other rows.  ``asked`` tells what each
partition would ask of a mailbox or board.  With a schema of fewer columns
(``.schema(...)``) only those are built.

Streams keep the last file, by time of change and name, as their offset; ``since``
and ``senders`` are options there.  Files are read through pyarrow's file systems,
so a path may be local, ``hdfs://`` or an object store's.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

UTC = dt.timezone.utc


@dataclass(frozen=True)
class Wanted:
    """What a reader was asked for: values of folder columns, and the earliest time."""

    values: tuple[tuple[str, tuple[str, ...]], ...] = ()
    since: dt.datetime | None = None

    def takes(self, name: str, value: str) -> bool:
        return all(value in wanted for column, wanted in self.values if column == name)

    def folder(self, parts: dict[str, str]) -> bool:
        day = parts.get("day")
        return all(self.takes(name, value) for name, value in parts.items()) and not (day and self.since and day < f"{self.since.astimezone(UTC):%Y-%m-%d}")

    def narrowed(self, name: str, values: Iterable) -> "Wanted":
        kept = tuple(str(v) for v in values)
        return replace(self, values=(*self.values, (name, kept)))

    def after(self, time: dt.datetime) -> "Wanted":
        time = time.replace(tzinfo=UTC) if time.tzinfo is None else time
        return replace(self, since=max(time, self.since) if self.since else time)


@dataclass
class LandedFile(InputPartition):
    path: str
    parts: dict[str, str]
    wanted: Wanted

    def __post_init__(self):
        self.value = self.path


#: Files of one task: at most this many, and no more once they have this many bytes.
MOST_FILES, ENOUGH_BYTES = 64, 16 << 20


@dataclass
class LandedFiles(InputPartition):
    """Some files that one task reads one after another: a task for each small one would mostly start and end."""

    files: tuple[LandedFile, ...]

    def __post_init__(self):
        self.value = self.files[0].path


def packed(files: list[LandedFile], root: str) -> list[LandedFiles]:
    """Files in their order, in groups of bounded number and size; a large file is a group by itself or ends one."""
    if not files:
        return []
    sizes = {info.path: info.size or 0 for info in _listed(root)}
    groups, most, size = [[]], max(1, min(MOST_FILES, -(-len(files) // 64))), 0
    for file in files:
        if groups[-1] and (len(groups[-1]) >= most or size >= ENOUGH_BYTES):
            groups.append([])
            size = 0
        groups[-1].append(file)
        size += sizes.get(file.path, 0)
    return [LandedFiles(tuple(group)) for group in groups]


def _listed(path: str) -> list[fs.FileInfo]:
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))


def landed(path: str) -> list[tuple[int, str, dict[str, str]]]:
    """(time of change in ns, path, folder columns) of the files below a folder; those with a leading underscore or dot are being written."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = []
    for info in infos:
        inner = info.path.removeprefix(root).strip("/").split("/")
        if info.type == fs.FileType.File and not any(x[0] in "_." for x in inner):
            out.append((info.mtime_ns or 0, info.path, dict(x.split("=", 1) for x in inner[:-1] if "=" in x)))
    return sorted(out, key=lambda x: x[:2])


def lines(path: str, root: str) -> Iterator[dict]:
    system = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
    with system.open_input_stream(path) as file:
        rest = b""
        while chunk := file.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from map(json.loads, filter(None, whole))
        if rest:
            yield json.loads(rest)


class Landing:
    """What batch and stream readers share: files to partitions, lines to rows."""

    time_column = ""
    folder_columns: tuple[str, ...] = ()

    def __init__(self, options, schema: StructType):
        self.root, self.names = options["path"], schema.names
        self.wanted = Wanted()

    def files(self, after: tuple[int, str] = (-1, ""), upto: tuple[int, str] | None = None) -> list[LandedFile]:
        return [LandedFile(path, parts, self.wanted) for at, path, parts in landed(self.root) if after < (at, path) and (upto is None or (at, path) <= upto) and self.wanted.folder(parts)]

    def row(self, item: dict, parts: dict[str, str], wanted: Wanted) -> dict | None:
        """The columns of one line, None where it isn't wanted."""
        raise NotImplementedError

    def read(self, partition: LandedFiles | None) -> Iterator[tuple]:
        if partition is None:  # there was no file at all
            return
        for file in partition.files:
            for item in lines(file.path, self.root):
                if (found := self.row(item, file.parts, file.wanted)) is not None:
                    yield tuple(found[name]() if callable(found[name]) else found[name] for name in self.names)


class BatchLanding(Landing, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.folder_columns and isinstance(f, EqualTo):
                self.wanted = self.wanted.narrowed(name, [f.value])
            elif name in self.folder_columns and isinstance(f, In):
                self.wanted = self.wanted.narrowed(name, f.value)
            elif name in (*self.folder_columns, self.time_column) and isinstance(f, IsNotNull):
                continue  # they never are
            elif name == self.time_column and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.wanted = self.wanted.after(f.value)
                if isinstance(f, GreaterThan):
                    yield f
            else:
                yield f

    def partitions(self) -> Sequence[LandedFiles]:
        return packed(self.files(), self.root)


class StreamLanding(Landing, DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        super().__init__(options, schema)
        if options.get("since"):
            self.wanted = self.wanted.after(dt.datetime.fromisoformat(options["since"]))
        if options.get("senders"):
            self.wanted = self.wanted.narrowed("sender", (s.strip() for s in options["senders"].split(",")))

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = landed(self.root)
        return {"at": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[LandedFiles]:
        return packed(self.files((start["at"], start["path"]), (end["at"], end["path"])), self.root)

    def commit(self, end: dict) -> None:
        pass


class Mails:
    time_column, folder_columns = "received_at", ("sender",)

    def row(self, item: dict, parts: dict[str, str], wanted: Wanted) -> dict | None:
        received = dt.datetime.fromtimestamp(int(item["internalDate"]) / 1000, UTC)
        if wanted.since and received < wanted.since:
            return None
        return {"message_id": item["id"], "sender": parts["sender"], "received_at": received, "asked": lambda: self.asked(wanted), "value": lambda: json.dumps(item)}

    def asked(self, wanted: Wanted) -> str:
        from millrace.sources.mail import search_query

        senders = [set(values) for name, values in wanted.values if name == "sender"]
        return search_query("", sorted(set.intersection(*senders)) if senders else [], int(wanted.since.timestamp()) if wanted.since else 0)


class Boards:
    time_column, folder_columns = "fetched_at", ("source_id", "adapter")

    def row(self, item: dict, parts: dict[str, str], wanted: Wanted) -> dict | None:
        fetched = dt.datetime.fromtimestamp(item["fetched_ms"] / 1000, UTC)
        if wanted.since and fetched < wanted.since:
            return None
        return {"source_id": lambda: int(parts["source_id"]), "adapter": parts["adapter"], "fetched_at": fetched, "asked": lambda: f"updated_after={wanted.since.astimezone(UTC):%Y-%m-%dT%H:%M:%SZ}" if wanted.since else "", "value": lambda: json.dumps(item["page"])}


class MailBatch(Mails, BatchLanding):
    pass


class MailStream(Mails, StreamLanding):
    pass


class BoardBatch(Boards, BatchLanding):
    pass


class BoardStream(Boards, StreamLanding):
    pass


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_mail"

    def schema(self) -> str:
        return "message_id string, sender string, received_at timestamp, asked string, value string"

    def reader(self, schema: StructType) -> MailBatch:
        return MailBatch(self.options, schema)

    def streamReader(self, schema: StructType) -> MailStream:
        return MailStream(self.options, schema)


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_board"

    def schema(self) -> str:
        return "source_id long, adapter string, fetched_at timestamp, asked string, value string"

    def reader(self, schema: StructType) -> BoardBatch:
        return BoardBatch(self.options, schema)

    def streamReader(self, schema: StructType) -> BoardStream:
        return BoardStream(self.options, schema)


def registered(spark):
    """The session, with both sources known and filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MailSource, BoardSource):
        spark.dataSource.register(source)
    return spark
