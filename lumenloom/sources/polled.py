"""A data source over services that are polled window by window, as batches and as streams.

A target is one account, region and group; a partition is one target and one
window of time, so that windows and targets are read side by side. A stream's
offset is the end of the last window that was read: Spark keeps it in the
query's checkpoint, and after a restart reading goes on behind it, each record
once. What a service says comes from a client, by default written responses.
"""

from __future__ import annotations

import importlib
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A window's length, how long after its end it is read, and how far back missed windows are made up for.
PERIOD_S, DELAY_S, CATCHUP_S = 300, 0, 24 * 3600
_SCHEMA = "account string, region string, log_group string, log_stream string, event_id string, ts_us long, message string"
_ARROW = pa.schema([("account", pa.string()), ("region", pa.string()), ("log_group", pa.string()), ("log_stream", pa.string()), ("event_id", pa.string()), ("ts_us", pa.int64()), ("message", pa.string())])
#: Records of one Arrow batch.
_ROWS = 10_000


@dataclass(frozen=True)
class Target:
    account: str
    region: str
    group: str


class ResponseFiles:
    """Pages of responses as JSON lines in folders of account, region and group, as partitioned writers lay them out.

    A page is an object with ``events`` (timestamp in milliseconds, eventId,
    logStreamName, message). A folder's name is a value, or ``key=value``.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.system, self.base = fs.FileSystem.from_uri(options["path"])

    def _inside(self, folder: str, kind: fs.FileType) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == kind and not f.base_name.startswith(("_", ".")))

    def _folders(self) -> dict[Target, str]:
        out, value = {}, lambda name: unquote(name.partition("=")[2] or name)
        for a in self._inside(self.base, fs.FileType.Directory):
            for r in self._inside(f"{self.base}/{a}", fs.FileType.Directory):
                for g in self._inside(f"{self.base}/{a}/{r}", fs.FileType.Directory):
                    out[Target(value(a), value(r), value(g))] = f"{self.base}/{a}/{r}/{g}"
        return out

    def targets(self) -> list[Target]:
        return list(self._folders())

    def pages(self, target: Target, start_us: int, end_us: int) -> Iterator[dict]:
        folder = self._folders()[target]
        for name in self._inside(folder, fs.FileType.File):
            with self.system.open_input_stream(f"{folder}/{name}") as stream:
                # A page is one response, of bounded size; a file is read page by page.
                for line in io.BufferedReader(stream):
                    if line.strip():
                        yield json.loads(line)


@dataclass
class Window(InputPartition):
    target: Target
    start_us: int
    end_us: int


def windows(start_us: int | None, end_us: int, period_us: int, catchup_us: int) -> list[tuple[int, int]]:
    """The windows from ``start_us`` to ``end_us``, oldest first; none that begins further back than ``catchup_us``, but the newest always.

    Without a start the newest alone. The first begins where reading stopped, also within a period.
    """
    if start_us is None:
        return [(end_us - period_us, end_us)]
    out, at = [], max(start_us, min(end_us - catchup_us, end_us - period_us))
    while at < end_us:
        stop = min(end_us, at - at % period_us + period_us)
        out.append((at, stop))
        at = stop
    return out


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        number = lambda k, default: round(float(self.options.get(k, default)) * 1e6)
        self.period, self.delay, self.catchup = number("period_s", PERIOD_S), number("delay_s", DELAY_S), number("catchup_s", CATCHUP_S)
        if self.period <= 0:
            raise ValueError("period_s must be above 0")

    def client(self):
        module, _, name = self.options.get("client", f"{__name__}:ResponseFiles").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def newest(self) -> int:
        """The last whole period's end, ``delay_s`` ago; ``until_us`` stands for now, as in tests and when reading again."""
        now = int(self.options.get("until_us", time.time_ns() // 1000)) - self.delay
        return now - now % self.period

    def since(self) -> int | None:
        return int(self.options["since_us"]) if "since_us" in self.options else None

    def partitions_of(self, start_us: int | None, end_us: int) -> list[Window]:
        return [Window(t, a, b) for t in self.client().targets() for a, b in windows(start_us, end_us, self.period, self.catchup)]

    def rows(self, w: Window | None) -> Iterator[pa.RecordBatch]:
        """The window's events with time, id and message; repeated pages give an event once. Without partitions Spark reads None."""
        if w is None:
            return
        rows, seen = [], set()
        for page in self.client().pages(w.target, w.start_us, w.end_us):
            for e in page.get("events") or []:
                at, event, said = e.get("timestamp"), e.get("eventId"), e.get("message")
                if at is None or event is None or said is None or not w.start_us <= at * 1000 < w.end_us or (at, event) in seen:
                    continue
                seen.add((at, event))
                rows.append((w.target.account, w.target.region, w.target.group, e.get("logStreamName"), event, at * 1000, said))
                if len(rows) == _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class PolledReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Window]:
        return self.partitions_of(self.since(), self.newest())

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PolledStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        since = self.since()
        return {"end_us": self.newest() - self.period if since is None else since}

    def latestOffset(self) -> dict:
        # A clock that goes back does not take back what was read.
        self.last = max(getattr(self, "last", 0), self.newest())
        return {"end_us": self.last}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        if start["end_us"] >= end["end_us"]:
            return []
        return self.partitions_of(start["end_us"], end["end_us"])

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class Polled(DataSource):
    """``spark.read.format("polled")`` and ``readStream``; options: path, period_s, delay_s, catchup_s, since_us, until_us, client.

    client: ``module:Class`` with targets() and pages(target, start_us, end_us),
    made from the options; written responses by default.
    """

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> PolledReader:
        return PolledReader(self.options)

    def streamReader(self, schema) -> PolledStream:
        return PolledStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Polled)
