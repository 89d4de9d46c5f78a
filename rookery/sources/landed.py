"""Landed odds snapshots as a data source: ``spark.read.format("landed_odds")`` and ``spark.readStream``, one row to an outcome.

A folder holds files named by the time they landed, ``<anything>-<time>.json``, each a JSON object to a line: an event, or a snapshot of it
(timestamp, data). Names sort in the order of landing. Batch reads cut the files among tasks; a stream's offset is the last name read, so a restart goes
on after it and repeats nothing. Files are opened where the tasks run, through Arrow's file systems, so ``path`` may be any address those know.

Options: ``path``; ``files`` to a task (8); ``since`` (exclusive) and ``until`` (inclusive), names that bound a batch read. A line that is no object, an event without
bookmakers and an outcome without a name give no row; a price or point that is no number is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, snapshot timestamp, event_id string, commence_time timestamp, home_team string, away_team string, book string, last_update timestamp, market string, name string, price double, point double"


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, names: list[str]):
        self.names = names


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def landed(path: str) -> list[str]:
    """The names of the landed files in their order; hidden and unfinished ones do not count."""
    from pyarrow import fs

    system, folder = _system(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.base_name[0] not in "._")


def _time(x) -> datetime | None:
    try:
        return datetime.fromisoformat(x).astimezone(timezone.utc) if x else None
    except (TypeError, ValueError):
        return None


def _number(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _list(x, key: str) -> list[dict]:
    found = x.get(key) if isinstance(x, dict) else None
    return [y for y in found if isinstance(y, dict)] if isinstance(found, list) else []


def rows(name: str, line: str) -> Iterator[tuple]:
    """The outcomes of one line."""
    try:
        event = json.loads(line)
    except ValueError:
        return
    snapshot = None
    if isinstance(event, dict) and isinstance(event.get("data"), dict):
        snapshot, event = _time(event.get("timestamp")), event["data"]
    for book in _list(event, "bookmakers"):
        for market in _list(book, "markets"):
            for o in _list(market, "outcomes"):
                if o.get("name") is not None:
                    yield (name, snapshot, event.get("id"), _time(event.get("commence_time")), event.get("home_team"), event.get("away_team"), book.get("key"), _time(book.get("last_update")), market.get("key"), o["name"], _number(o.get("price")), _number(o.get("point")))


class _Reading:
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("files", 8))
        self.since, self.until = options.get("since", ""), options.get("until")

    def _cut(self, names: list[str]) -> list[Files]:
        return [Files(names[i : i + self.each]) for i in range(0, len(names), self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, folder = _system(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as f:
                import io

                for line in io.TextIOWrapper(f, "utf-8"):
                    yield from rows(name, line)


class LandedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._cut([n for n in landed(self.path) if n > self.since and (self.until is None or n <= self.until)]) or [Files([])]


class LandedStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(landed(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self._cut([n for n in landed(self.path) if start["file"] < n <= end["file"]]) or [Files([])]

    def commit(self, end: dict) -> None:
        """Files stay where they landed."""


class LandedOdds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_odds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``landed_odds`` known to the session."""
    spark.dataSource.register(LandedOdds)
