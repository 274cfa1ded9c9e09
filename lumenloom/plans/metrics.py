"""Metric operators over ``events`` (series: event type or user) and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import enrich, hardware, processes, timeseries, windowhist
from lumenloom.plans.common import DAY, EVENTS, events, table

HOUR = DAY // 24


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running counter of cents per event type."""
    return timeseries.running_sum(events(spark, sf_dir).select("event_id", "at_us", "event_type", "cents"), ["event_type"], "at_us", "event_id", "cents", "counter")


_COUNTER = f"SELECT event_id, at_us, event_type, CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM {EVENTS}"


def windowhist_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics of the per-second increase of a running counter."""
    rates = windowhist.counter_rate(_counter(spark, sf_dir), ["event_type"], "at_us", "event_id", "counter")
    out = windowhist.window_stats(rates, ["event_type"], "rate", "at_us")
    return out.select("event_type", "window_us", "n", *[F.round(c, 4).alias(c) for c in ("sum_value", "min_value", "max_value")])


WINDOWHIST_RATE = f"""
WITH c AS ({_COUNTER}), r AS (
  SELECT event_type, at_us, (at_us - lag(at_us) OVER w) / 1e6 AS secs, counter - lag(counter) OVER w AS step FROM c WINDOW w AS (PARTITION BY event_type ORDER BY at_us, event_id)
), v AS (SELECT event_type, at_us, step / secs AS rate FROM r WHERE secs > 0 AND step >= 0)
SELECT event_type, at_us // {DAY} * {DAY} AS window_us, count(*) AS n, round(sum(rate), 4) AS sum_value, round(min(rate), 4) AS min_value, round(max(rate), 4) AS max_value FROM v GROUP BY 1, 2
"""


def windowhist_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter that falls now and then: rates, resets and pauses of six hours per user."""
    p = events(spark, sf_dir).select("event_id", "at_us", "user_id", (F.col("event_id") % 97).alias("v"))
    out = windowhist.counter_rate(p, ["user_id"], "at_us", "event_id", "v", idle_us=6 * HOUR)
    return out.select("event_id", "reset", F.round("rate", 9).alias("rate"))


WINDOWHIST_RESET = f"""
WITH p AS (SELECT event_id, at_us, user_id, event_id % 97 AS v FROM {EVENTS}),
l AS (SELECT *, at_us - lag(at_us) OVER w AS gap, v - lag(v) OVER w AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
SELECT event_id, coalesce(gap < {6 * HOUR} AND step < 0, false) AS reset, CASE WHEN gap < {6 * HOUR} AND gap > 0 AND step >= 0 THEN round(step / (gap / 1e6), 9) END AS rate FROM l
"""


def windowhist_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowhist.last_values(events(spark, sf_dir), ["user_id", "event_type"], "at_us", "event_id", ["event_id", "cents"])
    return out.select("user_id", "event_type", "window_us", "event_id", "cents")


WINDOWHIST_LAST = f"SELECT user_id, event_type, at_us // {DAY} * {DAY} AS window_us, arg_max(event_id, (at_us, event_id)) AS event_id, arg_max(cents, (at_us, event_id)) AS cents FROM {EVENTS} GROUP BY 1, 2, 3"


def windowhist_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowhist.cumulative(windowhist.window_stats(events(spark, sf_dir), ["event_type"], "cents", "at_us"), ["event_type"])


WINDOWHIST_CUMULATIVE = f"""
WITH d AS (SELECT event_type, at_us // {DAY} * {DAY} AS window_us, count(*) AS n, sum(cents) AS s, min(cents) AS lo, max(cents) AS hi FROM {EVENTS} GROUP BY 1, 2)
SELECT event_type, window_us, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(s) OVER w AS BIGINT) AS sum_value, min(lo) OVER w AS min_value, max(hi) OVER w AS max_value FROM d WINDOW w AS (PARTITION BY event_type ORDER BY window_us ROWS UNBOUNDED PRECEDING)
"""


def windowhist_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive, zero and negative values in buckets, as text."""
    p = events(spark, sf_dir).withColumn("v", F.col("cents") - 2000 * (F.col("event_id") % 2) * (F.col("event_id") % 5 == 0).cast("int"))
    h = windowhist.exponential_histogram(p, ["event_type"], "v", "at_us")
    line = lambda c: F.concat(F.col(f"{c}.offset"), F.lit(":"), F.array_join(f"{c}.counts", ","))
    return h.select("event_type", "window_us", "count", F.col("sum").cast("long").alias("sum"), F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), "scale", "zero_count", line("positive").alias("positive"), line("negative").alias("negative"))


def _bucket(v: str, s: str) -> str:
    return f"CAST(ceil(round(log2({v}) * pow(2.0, {s}), 9)) - 1 AS BIGINT)"


_SIDE = "list_transform(range(min(i), max(i) + 1), x -> coalesce(map_from_entries(list({'k': i, 'v': c}))[x], 0))"
WINDOWHIST_HISTOGRAM = f"""
WITH p AS (SELECT event_type, at_us // {DAY} * {DAY} AS window_us, CAST(cents - 2000 * (event_id % 2) * (CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM {EVENTS}),
r AS (SELECT event_type, window_us, count(*) AS count, sum(v) AS sum, min(v) AS min, max(v) AS max, count(*) FILTER (v = 0) AS zero_count,
  min(v) FILTER (v > 0) AS pl, max(v) FILTER (v > 0) AS ph, min(-v) FILTER (v < 0) AS nl, max(-v) FILTER (v < 0) AS nh FROM p GROUP BY 1, 2),
s AS (SELECT r.*, (SELECT max(k) FROM range(-10, 21) t(k) WHERE coalesce({_bucket('ph', 'k')} - {_bucket('pl', 'k')} < 16, true) AND coalesce({_bucket('nh', 'k')} - {_bucket('nl', 'k')} < 16, true)) AS scale FROM r),
b AS (SELECT p.event_type, p.window_us, v > 0 AS pos, {_bucket('abs(v)', 's.scale')} AS i, count(*) AS c FROM p JOIN s USING (event_type, window_us) WHERE v <> 0 GROUP BY 1, 2, 3, 4),
f AS (SELECT b.event_type, b.window_us, pos, min(i) || ':' || (SELECT string_agg(coalesce(c2.c, 0), ',' ORDER BY x) FROM range(min(b.i), max(b.i) + 1) g(x) LEFT JOIN b c2 ON c2.event_type = b.event_type AND c2.window_us = b.window_us AND c2.pos = b.pos AND c2.i = g.x) AS t FROM b GROUP BY 1, 2, 3)
SELECT s.event_type, s.window_us, s.count, CAST(s.sum AS BIGINT) AS sum, CAST(s.min AS BIGINT) AS min, CAST(s.max AS BIGINT) AS max, s.scale, s.zero_count, fp.t AS positive, fn.t AS negative
FROM s LEFT JOIN f fp ON fp.event_type = s.event_type AND fp.window_us = s.window_us AND fp.pos LEFT JOIN f fn ON fn.event_type = s.event_type AND fn.window_us = s.window_us AND NOT fn.pos
"""


def windowhist_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of all values up to each window's end."""
    p = events(spark, sf_dir).withColumn("v", F.col("cents") - 2000 * (F.col("event_id") % 2) * (F.col("event_id") % 5 == 0).cast("int"))
    h = windowhist.cumulative_histogram(p, ["event_type"], "v", "at_us")
    line = lambda c: F.concat(F.col(f"{c}.offset"), F.lit(":"), F.array_join(f"{c}.counts", ","))
    return h.select("event_type", "window_us", "count", F.col("sum").cast("long").alias("sum"), F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), "scale", "zero_count", line("positive").alias("positive"), line("negative").alias("negative"))


#: The same SQL over each window's own and all earlier points.
WINDOWHIST_RUNNING = WINDOWHIST_HISTOGRAM.replace("WITH p AS (", "WITH q AS (").replace("r AS (SELECT event_type", "p AS (SELECT w.event_type, w.window_us, q.v FROM (SELECT DISTINCT event_type, window_us FROM q) w JOIN q ON q.event_type = w.event_type AND q.window_us <= w.window_us),\nr AS (SELECT event_type", 1)


def odd_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowhist.odd_spacing(events(spark, sf_dir), ["user_id"], "at_us", "event_id", 6 * HOUR)


ODD_SPACING = f"""
WITH g AS (SELECT user_id, at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS gap FROM {EVENTS})
SELECT user_id, count(*) AS n_gaps, CAST(sum(CASE WHEN abs(gap - {6 * HOUR}) * 2 > {6 * HOUR} THEN 1 ELSE 0 END) AS BIGINT) AS n_odd FROM g WHERE gap IS NOT NULL GROUP BY 1
"""


def aligned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowhist.aligned_stats(events(spark, sf_dir), ["event_type"], "cents", "at_us", 6 * HOUR)
    return out.withColumn("value", F.round("value", 6))


ALIGNED_STATS = f"""
WITH w AS (SELECT event_type, at_us // {6 * HOUR} * {6 * HOUR} AS period_us, CAST(min(cents) AS DOUBLE) AS min, CAST(max(cents) AS DOUBLE) AS max, avg(cents) AS mean, CAST(sum(cents) AS DOUBLE) AS sum, CAST(count(cents) AS DOUBLE) AS count, quantile_cont(cents, 0.5) AS p50 FROM {EVENTS} GROUP BY 1, 2)
SELECT event_type, period_us, stat, round(value, 6) AS value FROM (UNPIVOT w ON min, max, mean, sum, count, p50 INTO NAME stat VALUE value)
"""


def missed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = events(spark, sf_dir).groupBy("user_id").agg(F.max("at_us").alias("m")).select("user_id", F.when(F.col("user_id") % 5 != 0, F.col("m") - F.pmod("m", F.lit(HOUR))).alias("last_end_us"))
    return windowhist.missed_windows(state, F.lit(1_706_745_600_000_000), HOUR, 300_000_000, 24)


MISSED_WINDOWS = f"""
WITH s AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN max(at_us) // {HOUR} * {HOUR} END AS last_end_us FROM {EVENTS} GROUP BY 1),
e AS (SELECT *, (1706745600000000 - 300000000) // {HOUR} * {HOUR} AS ends FROM s)
SELECT user_id, last_end_us, w AS window_start_us, w + {HOUR} AS window_end_us FROM (SELECT *, unnest(range(greatest(coalesce(last_end_us, ends - {HOUR}), ends - {24 * HOUR}), ends, {HOUR})) AS w FROM e)
"""


def counter_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("event_id", "at_us", "user_id", (F.col("event_id") % 97).alias("v"))
    return timeseries.reset_start(p, ["user_id"], "at_us", "event_id", "v").select("event_id", "start_us")


COUNTER_START = f"""
WITH p AS (SELECT event_id, at_us, user_id, event_id % 97 AS v FROM {EVENTS}),
l AS (SELECT *, CASE WHEN lag(v) OVER w > v OR lag(v) OVER w IS NULL THEN at_us END AS r FROM p WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
SELECT event_id, last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS start_us FROM l
"""


def counter_reset_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("event_id", "at_us", "event_type", (F.col("event_id") % 97).alias("v"))
    return timeseries.reset_proof(p, ["event_type"], "at_us", "event_id", "v").select("event_id", "total")


COUNTER_RESET_PROOF = f"""
WITH p AS (SELECT event_id, at_us, event_type, event_id % 97 AS v FROM {EVENTS}),
l AS (SELECT *, lag(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY event_type ORDER BY at_us, event_id))
SELECT event_id, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END) OVER (PARTITION BY event_type ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM l
"""


def rate_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.volume(events(spark, sf_dir).withColumn("kb", F.col("cents") % 100), ["event_type"], "at_us", "event_id", "kb", HOUR)
    return out.select("event_id", F.round("bytes", 0).cast("long").alias("bytes"))


RATE_VOLUME = f"""
WITH l AS (SELECT event_id, event_type, at_us, cents, at_us - lag(at_us) OVER (PARTITION BY event_type ORDER BY at_us, event_id) AS gap FROM {EVENTS})
SELECT event_id, CAST(round(CAST(sum(CASE WHEN gap > 0 AND gap <= {HOUR} THEN cents % 100 * 1024 * gap ELSE 0 END) OVER (PARTITION BY event_type ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) / 1e6, 0) AS BIGINT) AS bytes FROM l
"""


def fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.changes(events(spark, sf_dir), ["user_id"], "at_us", "event_id", "event_type")
    return out.select("event_id", "user_id", "event_type", "previous_value")


FACT_CHANGES = f"""
WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS previous_value FROM {EVENTS})
SELECT * FROM l WHERE previous_value IS DISTINCT FROM event_type
"""


def sorted_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.capped(events(spark, sf_dir), ["event_type"], [F.desc("cents"), "event_id"], 15).select("event_type", "event_id", "cents")


SORTED_CAPS = f"SELECT event_type, event_id, cents FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY cents DESC, event_id) <= 15"


def process_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of many processes as one per type and scrape: a scrape ends at a pause of 15 minutes."""
    whole = F.col("event_id") % 3 != 0
    p = events(spark, sf_dir).select(
        F.col("event_type").alias("name"), "at_us", F.lit("process.cpu.time").alias("metric"), F.lit("sum").alias("kind"), F.lit("cumulative").alias("temporality"), F.lit(True).alias("monotonic"),
        F.when(whole | (F.col("event_type") == "view"), F.col("cents")).alias("value_int"), F.when(~whole & (F.col("event_type") != "view"), F.col("cents") / 4.0).alias("value_double"), (F.col("at_us") - F.col("user_id")).alias("start_us"),
    )
    # the pause is scaled to the table's spacing
    own = p.where("name <> 'error'")
    ends = processes.scrape_ends(own, gap_us=900_000_000)
    timed = own.join(ends, "at_us")
    any_double = F.max(F.col("value_double").isNotNull())
    out = timed.groupBy("name", "scrape_us").agg(
        F.when(~any_double, F.sum("value_int")).alias("value_int"), F.when(any_double, F.sum(F.coalesce("value_double", F.lit(0.0))) + F.sum(F.coalesce("value_int", F.lit(0)))).alias("value_double"), F.min("start_us").alias("start_us"),
    )
    return out.withColumn("value_double", F.round("value_double", 4))


PROCESS_SUMS = f"""
WITH p AS (SELECT event_type AS name, at_us, CASE WHEN event_id % 3 <> 0 OR event_type = 'view' THEN cents END AS vi, CASE WHEN event_id % 3 = 0 AND event_type <> 'view' THEN cents / 4.0 END AS vd, at_us - user_id AS start_us FROM {EVENTS} WHERE event_type <> 'error'),
t AS (SELECT DISTINCT at_us FROM p), g AS (SELECT at_us, sum(CASE WHEN at_us - prev >= 900000000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY at_us) AS run FROM (SELECT at_us, lag(at_us) OVER (ORDER BY at_us) AS prev FROM t)),
s AS (SELECT at_us, max(at_us) OVER (PARTITION BY run) AS scrape_us FROM g)
SELECT name, scrape_us, CASE WHEN count(vd) = 0 THEN CAST(sum(vi) AS BIGINT) END AS value_int, CASE WHEN count(vd) > 0 THEN round(sum(coalesce(vd, 0)) + sum(coalesce(vi, 0)), 4) END AS value_double, min(start_us) AS start_us FROM p JOIN s USING (at_us) GROUP BY 1, 2
"""


def sum_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator itself: two event types summed up per scrape, the others passing through."""
    p = events(spark, sf_dir).select(
        F.col("event_type").alias("name"), (F.col("at_us") - F.pmod("at_us", F.lit(HOUR)) + F.col("user_id") * 100).alias("at_us"), F.lit("m").alias("metric"), F.lit("sum").alias("kind"), F.lit("cumulative").alias("temporality"),
        F.lit(True).alias("monotonic"), F.col("cents").alias("value_int"), F.lit(None).cast("double").alias("value_double"), F.lit(0).cast("long").alias("start_us"),
    )
    out = processes.sum_processes(p, F.col("name").isin("view", "click"), "name", [])
    return out.groupBy("name", "at_us", "monotonic").agg(F.count("*").alias("points"), F.sum("value_int").alias("total"), F.max("start_us").alias("start_us"))


SUM_PROCESSES = f"""
WITH p AS (SELECT event_type AS name, at_us // {HOUR} * {HOUR} + user_id * 100 AS at_us, cents FROM {EVENTS}),
s AS (SELECT name, max(at_us) OVER (PARTITION BY at_us // {HOUR}) AS at_us, cents FROM p WHERE name IN ('view', 'click'))
SELECT name, at_us, false AS monotonic, CAST(1 AS BIGINT) AS points, CAST(sum(cents) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS start_us FROM s GROUP BY 1, 2
UNION ALL SELECT name, at_us, true, count(*), CAST(sum(cents) AS BIGINT), CAST(0 AS BIGINT) FROM p WHERE name NOT IN ('view', 'click') GROUP BY 1, 2
"""


def process_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    metric = F.when(F.col("event_type") == "view", "process.cpu.time").when(F.col("event_type") == "click", "process.disk.io").otherwise("process.uptime")
    e = e.withColumn("day", F.floor(F.col("at_us") / DAY))
    p = e.select("user_id", "day", "at_us", metric.alias("metric"), F.when(metric == "process.uptime", "gauge").otherwise("sum").alias("kind"), F.when(metric != "process.uptime", "cumulative").alias("temporality"), F.when(metric == "process.disk.io", F.when(F.col("event_id") % 2 == 0, "read").otherwise("write")).alias("direction"), F.col("cents").cast("double").alias("value"))
    out = enrich.process_lifetime(p, ["user_id"], scrape="day").where("metric LIKE '%lifetime%'")
    return out.groupBy("user_id", "day", "metric", "direction").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"), F.max("at_us").alias("at_us"))


PROCESS_LIFETIME = f"""
WITH d AS (SELECT *, at_us // {DAY} AS day FROM {EVENTS}),
a AS (SELECT user_id, day, max(cents) FILTER (event_type NOT IN ('view', 'click')) AS age, sum(cents) FILTER (event_type = 'view') AS cpu, max(at_us) FILTER (event_type = 'view') AS seen_at FROM d GROUP BY 1, 2)
SELECT user_id, day, 'process.cpu.lifetime.ratio' AS metric, NULL AS direction, CAST(1 AS BIGINT) AS n, round(cpu / age, 6) AS value, seen_at AS at_us FROM a WHERE age > 0 AND cpu IS NOT NULL
UNION ALL SELECT d.user_id, d.day, 'process.disk.lifetime.rate', CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS d1, count(*), round(sum(cents / age), 6), max(at_us) FROM d JOIN a ON a.user_id = d.user_id AND a.day = d.day WHERE event_type = 'click' AND age > 0 GROUP BY d.user_id, d.day, d1
"""


def normalized_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("event_type") == "view", "system.cpu.load_average.1m").when(F.col("event_type") == "click", "process.cpu.utilization").otherwise("other")
    p = events(spark, sf_dir).select("event_id", metric.alias("metric"), F.col("cents").cast("double").alias("value"), (F.col("user_id") % 8).alias("cpus"))
    return enrich.normalized_load(p, "cpus").select("event_id", "metric", F.round("value", 6).alias("value"))


NORMALIZED_LOAD = f"""
WITH p AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'system.cpu.load_average.1m' WHEN 'click' THEN 'process.cpu.utilization' ELSE 'other' END AS metric, CAST(cents AS DOUBLE) AS v, user_id % 8 AS c FROM {EVENTS})
SELECT event_id, metric, round(v, 6) AS value FROM p
UNION ALL SELECT event_id, CASE metric WHEN 'process.cpu.utilization' THEN 'process.cpu.utilization.percpu' ELSE 'system.cpu.load_average.normalized.1m' END, round(CASE metric WHEN 'process.cpu.utilization' THEN v * c ELSE v / c END, 6) FROM p WHERE metric <> 'other' AND c > 0
"""


def worst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("ok", "degraded", "failed", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    p = events(spark, sf_dir).select("user_id", F.floor(F.col("at_us") / DAY).alias("day"), F.when((F.col("event_id") % 11 == 0) | (state != "failed"), state).otherwise("ok").alias("state"))
    worst = hardware.worst_state(p, ["user_id", "day"], "state")
    return hardware.one_hot(worst, "state", hardware.RANKS).select("user_id", "day", F.col("`hw.state`").alias("shown"), "value")


WORST_STATE = f"""
WITH p AS (SELECT user_id, at_us // {DAY} AS day, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' WHEN 2 THEN CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ok' END ELSE 'odd' END AS state FROM {EVENTS}),
w AS (SELECT user_id, day, max(CASE state WHEN 'failed' THEN 3 WHEN 'degraded' THEN 2 WHEN 'ok' THEN 0 ELSE -1 END) AS r FROM p GROUP BY 1, 2)
SELECT user_id, day, shown, CAST(r = n AS BIGINT) AS value FROM w, (VALUES ('ok', 0), ('predicted_failure', 1), ('degraded', 2), ('failed', 3)) s(shown, n)
"""

RULES = [
    hardware.Rule("view", "hw.temperature", {"kind": "1"}, unit="Cel", scale=0.5, labels={"label": "t-{user}", "gone": "{nothing}"}, constants={"hw.type": "cpu"}),
    hardware.Rule("view", "hw.fan.speed", {"kind": ""}, drop_value=0.0, index_attr="user", index_names={"1": "one"}),
    hardware.Rule("click", "hw.status", states=("ok", "failed"), state_map={"0": "ok", "1": "failed", "2": "drop"}, state_attr="kind"),
    hardware.Rule("error", "hw.status", states=("ok", "failed"), state_map={"0": "ok"}, default_state="failed", state_attr="kind"),
]


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("event_id", F.col("event_type").alias("metric"), F.lit("1").alias("unit"), F.col("cents").cast("double").alias("value"), F.create_map(F.lit("kind"), (F.col("event_id") % 4).cast("string"), F.lit("user"), F.col("user_id").cast("string")).alias("attributes"))
    a = F.col("attributes")
    out = hardware.map_points(p, RULES)
    return out.select("event_id", "metric", "unit", "value", *[a[k].alias(n) for k, n in (("label", "label"), ("hw.type", "hw_type"), ("hw.name", "hw_name"), ("hw.state", "hw_state"), ("hw.state.raw", "raw"))])


MAP_POINTS = f"""
WITH p AS (SELECT event_id, event_type AS m, CAST(cents AS DOUBLE) AS v, event_id % 4 AS k, user_id AS u FROM {EVENTS})
SELECT event_id, 'hw.temperature' AS metric, 'Cel' AS unit, v * 0.5 AS value, 't-' || u AS label, 'cpu' AS hw_type, NULL AS hw_name, NULL AS hw_state, NULL AS raw FROM p WHERE m = 'view' AND k = 1
UNION ALL SELECT event_id, 'hw.fan.speed', '1', v, NULL, NULL, CASE WHEN u = 1 THEN 'one' ELSE u::VARCHAR END, NULL, NULL FROM p WHERE m = 'view' AND k <> 1 AND v <> 0
UNION ALL SELECT event_id, 'hw.status', '1', CAST(s = CASE k WHEN 0 THEN 'ok' ELSE 'failed' END AS INT), NULL, NULL, NULL, s, NULL FROM p, (VALUES ('ok'), ('failed')) x(s) WHERE m = 'click' AND k < 2
UNION ALL SELECT event_id, 'click', '1', v, NULL, NULL, NULL, NULL, NULL FROM p WHERE m = 'click' AND k = 3
UNION ALL SELECT event_id, 'hw.status', '1', CAST(s = CASE k WHEN 0 THEN 'ok' ELSE 'failed' END AS INT), NULL, NULL, NULL, s, CASE WHEN k <> 0 THEN k::VARCHAR END FROM p, (VALUES ('ok'), ('failed')) x(s) WHERE m = 'error'
UNION ALL SELECT event_id, m, '1', v, NULL, NULL, NULL, NULL, NULL FROM p WHERE m NOT IN ('view', 'click', 'error')
"""


def nvme_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health pages built from order lines, read back."""
    le = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * i, 2) for i in range(n)]))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    page = F.concat(
        F.unhex(F.lpad(F.hex(F.col("l_linenumber").cast("long")), 2, "0")), le(F.col("l_partkey"), 2), F.unhex(F.lit("640A")), F.unhex(F.lit("05")), zeros(26), le(F.col("l_orderkey"), 8), F.unhex(F.lit("0100000000000000")), le(F.col("l_partkey"), 8), zeros(8), zeros(96), le(F.col("l_suppkey"), 8), zeros(344),
    )
    out = hardware.nvme_health(li.withColumn("page", page))
    keep = ("critical_warning", "temperature_k", "spare", "used", "units_read", "units_written", "media_errors")
    return out.groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(*[F.max(c).cast("string").alias(c) for c in keep])


NVME_HEALTH = """
SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber::VARCHAR AS critical_warning, (l_partkey % 65536)::VARCHAR AS temperature_k, '100' AS spare, '5' AS used,
'18446744073709551615' AS units_read, l_partkey::VARCHAR AS units_written, l_suppkey::VARCHAR AS media_errors FROM lineitem
"""

QUERIES = {
    "windowhist_rate": windowhist_rate, "windowhist_reset": windowhist_reset, "windowhist_last": windowhist_last, "windowhist_cumulative": windowhist_cumulative, "windowhist_histogram": windowhist_histogram, "windowhist_running": windowhist_running,
    "odd_spacing": odd_spacing, "aligned_stats": aligned_stats, "missed_windows": missed_windows, "counter_start": counter_start, "counter_reset_proof": counter_reset_proof, "rate_volume": rate_volume,
    "fact_changes": fact_changes, "sorted_caps": sorted_caps, "process_sums": process_sums, "sum_processes": sum_processes, "process_lifetime": process_lifetime, "normalized_load": normalized_load,
    "worst_state": worst_state, "map_points": map_points, "nvme_health": nvme_health,
}
ORACLES = {
    "windowhist_rate": WINDOWHIST_RATE, "windowhist_reset": WINDOWHIST_RESET, "windowhist_last": WINDOWHIST_LAST, "windowhist_cumulative": WINDOWHIST_CUMULATIVE, "windowhist_histogram": WINDOWHIST_HISTOGRAM, "windowhist_running": WINDOWHIST_RUNNING,
    "odd_spacing": ODD_SPACING, "aligned_stats": ALIGNED_STATS, "missed_windows": MISSED_WINDOWS, "counter_start": COUNTER_START, "counter_reset_proof": COUNTER_RESET_PROOF, "rate_volume": RATE_VOLUME,
    "fact_changes": FACT_CHANGES, "sorted_caps": SORTED_CAPS, "process_sums": PROCESS_SUMS, "sum_processes": SUM_PROCESSES, "process_lifetime": PROCESS_LIFETIME, "normalized_load": NORMALIZED_LOAD,
    "worst_state": WORST_STATE, "map_points": MAP_POINTS, "nvme_health": NVME_HEALTH,
}
