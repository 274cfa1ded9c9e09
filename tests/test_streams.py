"""Streams give what the batch operators give on the same input, and take late files in."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import recombine, timeseries, windowhist
from lumenloom.plans.common import events
from lumenloom.streaming import windows

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode="append"):
    # With timeouts by the clock a query would go on with empty batches for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    ev = events(spark, SF).withColumn("at", F.timestamp_micros("at_us")).select("event_id", "at_us", "at", "event_type", "user_id", "cents")
    ev.orderBy("at_us").coalesce(1).write.parquet(str(tmp_path / "in"))
    return ev, spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))


def test_window_stats(spark, stream):
    ev, live = stream
    got = run(spark, windows.window_stats(live, ["event_type"], "cents", "at", "1 day"), "s1", "complete")
    want = windowhist.window_stats(ev, ["event_type"], "cents", "at_us")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_rates_and_changes(spark, stream):
    ev, live = stream
    got = run(spark, windows.counter_rates(live, "event_type", "at_us", "event_id"), "s2")
    want = windowhist.counter_rate(ev, ["event_type"], "at_us", "event_id", "event_id").where("rate IS NOT NULL").select("event_type", "at_us", "rate")
    rows = [r for r in got.collect() if r[2] is not None]
    assert sorted((r[0], r[1], round(r[2], 9)) for r in rows) == sorted((r[0], r[1], round(r[2], 9)) for r in want.collect())
    got = run(spark, windows.change_events(live, "user_id", "at_us", "event_type"), "s3")
    want = timeseries.changes(ev, ["user_id"], "at_us", "event_id", "event_type")
    assert got.count() == want.count()


def test_recombine_keeps_every_line(spark, stream):
    ev, live = stream
    lines = live.withColumn("line", F.concat("event_type", F.lit(" "), "event_id"))
    hour = 3_600_000_000
    got = run(spark, windows.recombined(lines, "user_id", "at_us", "line", "^click", gap_us=5 * hour, max_lines=4, flush_ms=600_000), "s4").select("key", "at_us", "n_lines", "body")
    batch = recombine.recombine(ev.withColumn("line", F.concat("event_type", F.lit(" "), "event_id")).withColumn("k", F.col("user_id").cast("string")), "k", "at_us", "event_id", "line", "^click", gap_us=5 * hour, max_us=10**15, max_lines=4)
    a, b = {tuple(r) for r in got.collect()}, {tuple(r) for r in batch.collect()}
    assert a <= b
    open_ = b - a  # a key's last record is still in its state
    assert len(open_) == ev.select("user_id").distinct().count()


def test_first_seen(spark, stream):
    ev, live = stream
    got = run(spark, windows.first_seen(live, ["user_id"], "at", "60 days"), "s5")
    assert got.count() == ev.select("user_id").distinct().count()


def test_window_histograms_equal_the_batch_and_forget_idle_series(spark, tmp_path):
    day = 86_400_000_000
    ev = events(spark, SF).withColumn("v", F.when(F.col("event_id") % 3 == 0, -F.col("value")).when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("value") * F.col("event_id"))).select("event_type", "at_us", "v")
    last = ev.agg(F.max("at_us")).first()[0]
    # Later points of other series move the watermark behind all windows of these.
    more = [("only", last + 3 * day, 1.0), ("end", last + 9 * day, 2.0), ("end", last + 20 * day, float("nan")), ("tail", last + 30 * day, 1.0)]
    more = [spark.createDataFrame([m], "event_type string, at_us long, v double") for m in more]
    rows = ev
    for m in more:
        rows = rows.unionByName(m)
    middle = ev.agg(F.percentile_approx("at_us", 0.5)).first()[0]
    for i, part in enumerate((ev.where(F.col("at_us") < middle), ev.where(F.col("at_us") >= middle), *more)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    q = windows.window_histograms(live, "event_type", "v", "at_us", day, late="2 days").writeStream.format("memory").queryName("s6").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    got = {(r.series, r.window_us): r for r in spark.table("s6").collect()}
    want = {(r.event_type, r.window_us): r for r in windowhist.exponential_histogram(rows, ["event_type"], "v", "at_us", day).collect()}
    passed = last + 30 * day - 2 * day
    due = {k for k in want if k[1] + day <= passed}
    assert set(got) == due and len(due) > 20 and ("tail", max(k[1] for k in want)) not in due
    for k in due:
        a, b = got[k], want[k]
        assert (a["count"], a.zero_count, a.scale, a.positive, a.negative) == (b["count"], b.zero_count, b.scale, b.positive, b.negative) and abs(a["sum"] - b["sum"]) < 1e-6 * max(1, abs(b["sum"])), k


def test_open_records_are_bounded_and_no_line_is_lost(spark, tmp_path):
    """10,000 keys of three lines, in two files; at most 1,000 records stay open, and these leave by the clock."""
    rows = spark.range(30_000).selectExpr("concat('k', id % 10000) AS key", "(id % 10000) * 3000 + id div 10000 AS at_us", "concat(if(id < 10000, 'BEGIN ', ' more '), id) AS line")
    odd = spark.createDataFrame([(None, 5, "no key"), ("k1", 6, "")], rows.schema)
    for i, part in enumerate((rows.where("at_us < 15000000").unionByName(odd), rows.where("at_us >= 15000000"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    made = windows.recombined_within(live, "key", "at_us", "line", "^BEGIN", max_open=1000, shards=8, flush_ms=500, hold_ms=2000)
    q = made.writeStream.format("memory").queryName("s7").outputMode("append").start()
    end = time.time() + 120
    while time.time() < end and q.exception() is None and spark.table("s7").agg(F.sum("n_lines")).first()[0] != 30_002:
        time.sleep(1)
    q.stop()
    got = spark.table("s7").collect()
    assert sum(r.n_lines for r in got) == 30_002
    assert sorted(x for r in got for x in r.body.split("\n")) == sorted([*[r.line for r in rows.collect()], "no key", ""])
    # By time a key's three lines follow each other, so that no eviction parts them.
    assert {r.n_lines for r in got if r.key and r.body} == {3}


def test_open_records_are_those_of_the_batch(spark):
    """Pauses, begins, cuts by lines and by time as recombine() has them."""
    rnd = random.Random(3)
    rows, at = [], dict.fromkeys("abc", 0)
    for i in range(2000):
        k = rnd.choice("abc")
        at[k] += rnd.choice((1, 40, 900, 9_000, 10_001))
        rows.append((k, at[k], i, f"{rnd.choice(('BEGIN', 'x', 'x', 'x', 'x'))} {i}"))
    batch = recombine.recombine(spark.createDataFrame(rows, "k string, t long, i long, line string"), "k", "t", "i", "line", "^BEGIN", max_us=20_000, max_lines=4)
    held = windows.OpenRecords(re.compile("^BEGIN"), 3, 10_000, 20_000, 4, 1 << 16)
    for k, t, _, line in rows:
        held.add(k, t, line, 0)
    assert held.flush(10, 100, 200) == 90 and held.flush(100, 100, 200) is None
    assert sorted(held.done) == sorted(tuple(r) for r in batch.select("k", "t", "n_lines", "body").collect())
    held = windows.OpenRecords(re.compile("^BEGIN"), 2, 10_000, 20_000, 50, 10)
    for k, t, line in (("a", 1, "BEGIN"), ("b", 2, "x"), ("a", 3, "1234"), ("a", 4, "5"), ("c", 5, "y" * 99)):
        held.add(k, t, line, t)
    assert held.done == [("a", 1, 2, "BEGIN\n1234"), ("b", 2, 1, "x")] and list(held.open) == ["a", "c"] and held.open["c"]["bytes"] == 99
    assert held.flush(104, 100, 10_000) == 1 and held.done[-1] == ("a", 4, 1, "5")
