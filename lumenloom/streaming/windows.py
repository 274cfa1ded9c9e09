"""Windows, change events and first sightings over streams.

Each function takes and returns a streaming DataFrame; on a static one those
without state of their own give the batch result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenloom.operators.recombine import GAP_US, MAX_BYTES, MAX_LINES, MAX_US
from lumenloom.operators.windowhist import MAX_SCALE, MAX_SIZE, MIN_SCALE


def window_stats(points: DataFrame, series: list[str], value: str, ts: str, every: str) -> DataFrame:
    """n, sum, least and greatest value per series and window; points later than one window are dropped."""
    live = points.withWatermark(ts, every) if points.isStreaming else points
    return (
        live.where(F.col(value).isNotNull())
        .groupBy(*series, F.window(ts, every).alias("w"))
        .agg(F.count(value).alias("n"), F.sum(value).alias("sum_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
        .select(*series, F.unix_micros("w.start").alias("window_us"), "n", "sum_value", "min_value", "max_value")
    )


def first_seen(files: DataFrame, key: list[str], ts: str, keep: str = "2 seconds") -> DataFrame:
    """Each key once within ``keep`` of its first sighting."""
    return files.withWatermark(ts, keep).dropDuplicatesWithinWatermark(key) if files.isStreaming else files.dropDuplicates(key)


def counter_rates(points: DataFrame, key: str, at_us: str, value: str, idle_ms: int = 600_000) -> DataFrame:
    """key, at_us and rate: increase per second since the series' last reading, which lives in the state.

    The first reading, one after a pause of ``idle_ms`` and a fall have no row. A
    reading that is not later than the last one has a row with a null rate, so
    that what comes late can be counted. Within a batch readings go by time.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        # Of a batch two numbers a reading are kept, as their order in time is needed.
        times, values = (np.concatenate(x) for x in zip(*[(b.at_us.to_numpy(), b.value.to_numpy()) for b in batches]))
        order = np.lexsort((values, times))
        out = []
        for at, v in zip(times[order].tolist(), values[order].tolist()):
            if last is not None and at <= last[0]:
                out.append((k[0], at, None))
                continue
            if last is not None and v >= last[1]:
                out.append((k[0], at, (v - last[1]) / ((at - last[0]) / 1e6)))
            last = (int(at), float(v))
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "at_us", "rate"]).astype({"rate": "float64"})

    rows = points.select(F.col(key).cast("string").alias("key"), F.col(at_us).cast("long").alias("at_us"), F.col(value).cast("double").alias("value")).where("key IS NOT NULL AND at_us IS NOT NULL AND value IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at_us long, rate double", "at_us long, value double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def change_events(facts: DataFrame, key: str, at_us: str, value: str, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """key, at_us, value and previous_value where a key's value first appears or changes.

    A key of which nothing came for ``idle_ms`` is forgotten, so that the state
    holds live keys alone; its next value counts as a first one.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.exists, state.get[0] if state.exists else None
        out = []
        for at, v in pd.concat(list(batches)).sort_values("at_us")[["at_us", "value"]].itertuples(index=False):
            if not seen or v != last:
                out.append((k[0], at, v, last))
            seen, last = True, v
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "at_us", "value", "previous_value"])

    rows = facts.select(F.col(key).cast("string").alias("key"), F.col(at_us).cast("long").alias("at_us"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at_us long, value string, previous_value string", "value string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recombined(lines: DataFrame, key: str, at_us: str, line: str, first_entry: str, gap_us: int = 10_000, max_lines: int = 50, flush_ms: int = 80) -> DataFrame:
    """key, at_us, n_lines and body of records joined from lines, the open one of each key in the state.

    A record ends at the next that begins, after a pause, at ``max_lines``, or
    ``flush_ms`` after its key's last line.
    """
    begins = re.compile(first_entry)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            if open_:
                out.append((k[0], open_[0], open_[2], open_[3]))
            state.remove()
        else:
            for at, text in pd.concat(list(batches)).sort_values("at_us", kind="stable")[["at_us", "line"]].itertuples(index=False):
                if open_ and not begins.search(text) and at - open_[1] <= gap_us and open_[2] < max_lines:
                    open_ = [open_[0], int(at), open_[2] + 1, f"{open_[3]}\n{text}"]
                else:
                    if open_:
                        out.append((k[0], open_[0], open_[2], open_[3]))
                    open_ = [int(at), int(at), 1, text]
            state.update(tuple(open_))
            state.setTimeoutDuration(flush_ms)
        yield pd.DataFrame(out, columns=["key", "at_us", "n_lines", "body"])

    rows = lines.select(F.col(key).cast("string").alias("key"), F.col(at_us).cast("long").alias("at_us"), F.col(line).alias("line")).where("key IS NOT NULL AND line <> ''")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at_us long, n_lines long, body string", "began long, last long, n long, body string", "append", GroupStateTimeout.ProcessingTimeTimeout)


class OpenRecords:
    """Records of one shard that may still go on, at most ``most`` of them."""

    def __init__(self, begins: re.Pattern, most: int, gap_us: int, max_us: int, max_lines: int, max_bytes: int, open_: dict[str, dict] | None = None) -> None:
        self.begins, self.most, self.gap_us, self.max_us, self.max_lines, self.max_bytes = begins, most, gap_us, max_us, max_lines, max_bytes
        self.open = open_ or {}
        self.done: list[tuple[str, int, int, str]] = []

    def send(self, key: str) -> None:
        r = self.open.pop(key)
        self.done.append((key, r["at"], r["n"], r["body"]))

    def add(self, key: str, at: int, line: str, now_ms: int) -> None:
        """Goes on with the key's record, or sends it and begins another; then sends the one that began first if there are too many."""
        r, size = self.open.get(key), len(line.encode("utf-8", "surrogatepass"))
        if r and not self.begins.search(line) and at - r["last"] <= self.gap_us:
            # Cuts by lines and by time are counted from the run's begin, as recombine() does.
            part = max((r["before"] + r["n"]) // self.max_lines, (at - r["t0"]) // (self.max_us + 1))
            if part == r["part"] and r["bytes"] + 1 + size <= self.max_bytes:
                r |= {"last": at, "n": r["n"] + 1, "bytes": r["bytes"] + 1 + size, "body": f"{r['body']}\n{line}", "seen": now_ms}
                return
            t0, before = r["t0"], r["before"] + r["n"]
        else:
            t0, before, part = at, 0, 0
        if r:
            self.send(key)
        self.open[key] = {"t0": t0, "before": before, "part": part, "at": at, "last": at, "n": 1, "bytes": size, "body": line, "began": now_ms, "seen": now_ms}
        if len(self.open) > self.most:
            # A key is put in anew with each record, so the first key's record began first.
            self.send(next(iter(self.open)))

    def flush(self, now_ms: int, flush_ms: int, hold_ms: int) -> int | None:
        """Sends what got no line for ``flush_ms`` or began ``hold_ms`` ago; the wait until the next is due."""
        due = {k: min(r["seen"] + flush_ms, r["began"] + hold_ms) for k, r in self.open.items()}
        for k in [k for k, at in due.items() if at <= now_ms]:
            self.send(k)
        return min((due[k] - now_ms for k in self.open), default=None)


def recombined_within(
    lines: DataFrame, key: str, at_us: str, line: str, first_entry: str, max_open: int = 1000, shards: int = 64, gap_us: int = GAP_US, max_us: int = MAX_US, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, flush_ms: int = 80, hold_ms: int = 80
) -> DataFrame:
    """key, at_us, n_lines and body of each record, with at most ``max_open`` open records over all keys.

    Keys are dealt over ``shards`` by a hash; a shard holds its share of
    ``max_open`` (at least one), and if there are more its record that began
    first is sent, whole lines as they are. So the state is bounded, however many
    keys there are, by max_open times ``max_bytes`` and a line; what follows in
    a key that was sent begins a record of its own. A record also ends at the next
    that begins, after a pause, and every ``max_us`` or ``max_lines`` after
    its run's begin, by the lines' own times, as recombine() has it; before
    ``max_bytes`` would be passed; and by the clock ``flush_ms`` after
    its last line or ``hold_ms`` after its begin. No line is dropped: those without
    a key or a text are records of their own. Within a micro-batch, which the
    source's limits bound, a shard's lines go by time.
    """
    begins, share = re.compile(first_entry), max(1, max_open // shards)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OpenRecords(begins, share, gap_us, max_us, max_lines, max_bytes, json.loads(state.get[0]) if state.exists else None)
        now = state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            for of, at, text in pd.concat(list(batches)).sort_values("at_us", kind="stable")[["key", "at_us", "line"]].itertuples(index=False):
                held.add(of, int(at), text, now)
        wait = held.flush(now, flush_ms, hold_ms)
        if wait is not None:
            state.update((json.dumps(held.open),))
            state.setTimeoutDuration(max(1, wait))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(held.done, columns=["key", "at_us", "n_lines", "body"])

    rows = lines.select(F.col(key).cast("string").alias("key"), F.col(at_us).cast("long").alias("at_us"), F.col(line).alias("line"))
    joins = F.coalesce((F.col("line") != "") & F.col("key").isNotNull() & F.col("at_us").isNotNull(), F.lit(False))
    alone = rows.where(~joins).select("key", "at_us", F.lit(1).cast("long").alias("n_lines"), F.col("line").alias("body"))
    dealt = rows.where(joins).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    made = dealt.groupBy("shard").applyInPandasWithState(run, "key string, at_us long, n_lines long, body string", "open string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return made.unionByName(alone)


class _Buckets:
    """Counts by exponential bucket of one sign, of at most ``most`` neighbouring buckets: the scale falls as the range grows."""

    def __init__(self, scale: int, counts: dict[int, int]) -> None:
        self.scale, self.counts = scale, counts

    def lower(self, by: int) -> None:
        merged: dict[int, int] = {}
        for i, n in self.counts.items():
            merged[i >> by] = merged.get(i >> by, 0) + n
        self.scale, self.counts = self.scale - by, merged

    def fit(self, most: int) -> None:
        while self.counts and max(self.counts) - min(self.counts) >= most and self.scale > MIN_SCALE:
            self.lower(1)

    def add(self, other: _Buckets, most: int) -> None:
        if other.scale > self.scale:
            other.lower(other.scale - self.scale)
        elif self.scale > other.scale:
            self.lower(self.scale - other.scale)
        for i, n in other.counts.items():
            self.counts[i] = self.counts.get(i, 0) + n
        self.fit(most)

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> _Buckets:
        index, n = np.unique(np.ceil(np.round(np.log2(sizes) * 2.0**MAX_SCALE, 9)).astype(np.int64) - 1, return_counts=True)
        out = cls(MAX_SCALE, dict(zip(index.tolist(), n.tolist())))
        out.fit(most)
        return out


class Histogram:
    """A window's summary that values and other summaries can be added to; its size does not grow with their number."""

    def __init__(self, most: int, count: int = 0, total: float = 0.0, low: float = math.inf, high: float = -math.inf, zero: int = 0, positive: _Buckets | None = None, negative: _Buckets | None = None) -> None:
        self.most, self.count, self.total, self.low, self.high, self.zero = most, count, total, low, high, zero
        self.positive, self.negative = positive or _Buckets(MAX_SCALE, {}), negative or _Buckets(MAX_SCALE, {})

    @classmethod
    def of(cls, values: np.ndarray, most: int) -> Histogram:
        return cls(most, len(values), float(values.sum()), float(values.min()), float(values.max()), int((values == 0).sum()), _Buckets.of(values[values > 0], most), _Buckets.of(-values[values < 0], most))

    def add(self, other: Histogram) -> None:
        self.count, self.total, self.zero = self.count + other.count, self.total + other.total, self.zero + other.zero
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.positive.add(other.positive, self.most)
        self.negative.add(other.negative, self.most)

    def dump(self) -> list:
        return [self.most, self.count, self.total, self.low, self.high, self.zero, *[[b.scale, list(b.counts.items())] for b in (self.positive, self.negative)]]

    @classmethod
    def load(cls, x: list) -> Histogram:
        return cls(*x[:6], *[_Buckets(scale, {i: n for i, n in counts}) for scale, counts in x[6:]])

    def row(self) -> dict:
        """The two signs at one scale, counts from the least bucket to the greatest."""
        scale = min(self.positive.scale, self.negative.scale)
        sides = []
        for b in (self.positive, self.negative):
            b.lower(b.scale - scale)
            lo, hi = (min(b.counts), max(b.counts)) if b.counts else (0, -1)
            sides.append({"offset": lo, "counts": [b.counts.get(i, 0) for i in range(lo, hi + 1)]} if b.counts else None)
        return {"count": self.count, "sum": self.total, "min": self.low, "max": self.high, "scale": scale, "zero_count": self.zero, "positive": sides[0], "negative": sides[1]}


_SIDE = "struct<offset:bigint,counts:array<bigint>>"
HISTOGRAM = f"series string, window_us long, count long, sum double, min double, max double, scale int, zero_count long, positive {_SIDE}, negative {_SIDE}"


def window_histograms(points: DataFrame, key: str, value: str, at_us: str, every_us: int, late: str = "0 seconds", max_size: int = MAX_SIZE) -> DataFrame:
    """HISTOGRAM rows, one per series and window, sent when the watermark has passed the window's end; as exponential_histogram() of a static table.

    Each task first sums up its own points, so that a hot series shuffles a
    summary per task and window. The state holds open windows alone; a window
    leaves it as it is sent, and a series with its last one. Null and non-finite
    values are left out; what comes after its window was sent is dropped.
    """

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[np.isfinite(pdf.value.to_numpy())]
            at = pdf.at_us - pdf.at_us % every_us
            rows = [(k, w, int(g.at_us.max()), json.dumps(Histogram.of(g.value.to_numpy(), max_size).dump())) for (k, w), g in pdf.groupby(["key", at])]
            yield pd.DataFrame(rows, columns=["key", "window_us", "last_us", "part"])

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = {int(w): Histogram.load(x) for w, x in json.loads(state.get[0]).items()} if state.exists else {}
        passed = state.getCurrentWatermarkMs() * 1000
        for pdf in batches:
            for w, part in zip(pdf.window_us, pdf.part):
                if w + every_us > passed:
                    new = Histogram.load(json.loads(part))
                    open_[w].add(new) if w in open_ else open_.update({w: new})
        done = sorted(w for w in open_ if w + every_us <= passed)
        out = [{"series": k[0], "window_us": w} | open_.pop(w).row() for w in done]
        if open_:
            state.update((json.dumps({w: h.dump() for w, h in open_.items()}),))
            state.setTimeoutTimestamp(max((min(open_) + every_us) // 1000, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["series", "window_us", "count", "sum", "min", "max", "scale", "zero_count", "positive", "negative"])

    rows = points.select(F.col(key).cast("string").alias("key"), F.col(at_us).cast("long").alias("at_us"), F.col(value).cast("double").alias("value")).where("key IS NOT NULL AND at_us IS NOT NULL AND value IS NOT NULL")
    parts = rows.mapInPandas(sum_up, "key string, window_us long, last_us long, part string")
    parts = parts.withColumn("at", F.timestamp_micros("last_us")).withWatermark("at", late)
    return parts.groupBy("key").applyInPandasWithState(run, HISTOGRAM, "open string", "append", GroupStateTimeout.EventTimeTimeout)
