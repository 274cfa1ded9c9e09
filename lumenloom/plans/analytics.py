"""Queries that users run over shaped records and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.operators import timeseries, windowhist
from lumenloom.plans.common import DAY, EVENTS, events

OLD_NAMES = ("deployment.environment", "rpc.system", "rpc.service", "rpc.response.status_code", "event.name", "code.filepath", "code.lineno", "code.function")


def old_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often deprecated attribute names still occur."""
    a = F.create_map(F.concat(F.lit("code."), F.element_at(F.array(F.lit("filepath"), F.lit("lineno"), F.lit("new")), (F.col("event_id") % 3 + 1).cast("int"))), F.lit("x"), F.when(F.col("event_type") == "view", "rpc.system").otherwise("ok"), F.lit("y"))
    keys = events(spark, sf_dir).select(F.explode(F.map_keys(a)).alias("k"))
    return keys.where(F.col("k").isin(*OLD_NAMES)).groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k")


OLD_NAMES_SQL = f"""
SELECT k, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'code.filepath' WHEN 1 THEN 'code.lineno' ELSE 'code.new' END AS k FROM {EVENTS} UNION ALL SELECT CASE WHEN event_type = 'view' THEN 'rpc.system' ELSE 'ok' END FROM {EVENTS})
WHERE k IN ({', '.join(repr(n) for n in OLD_NAMES)}) GROUP BY 1
"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per host, whole numbers read from text."""
    a = F.create_map(F.lit("host"), F.col("user_id").cast("string"), F.lit("bytes"), F.when(F.col("event_id") % 4 == 0, "n/a").otherwise((F.col("cents") * 1048576).cast("string")))
    e = events(spark, sf_dir).select(a.alias("a"))
    return e.groupBy(F.col("a")["host"].alias("host")).agg(F.count("*").alias("modules"), F.sum(F.coalesce(F.col("a")["bytes"].try_cast("long"), F.lit(0)) / 1048576).cast("long").alias("mib"))


INVENTORY = f"SELECT user_id::VARCHAR AS host, count(*) AS modules, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE cents END) AS BIGINT) AS mib FROM {EVENTS} GROUP BY 1"


def steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at which the value has stayed at or above 500 for the 12 hours before, per user; by a range window over each day and the 12 hours before it."""
    back = DAY // 2
    w = Window.partitionBy("user_id", "day").orderBy("at_us").rangeBetween(-back, 0)
    later = F.when(F.pmod("at_us", F.lit(DAY)) >= DAY - back, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = events(spark, sf_dir).withColumn("later", F.explode(later)).withColumn("day", F.floor(F.col("at_us") / DAY) + F.col("later"))
    e = e.withColumn("least", F.min("cents").over(w)).where("later = 0")
    return e.where("least >= 500").select("event_id", "user_id", "least")


STEADY = f"SELECT event_id, user_id, min(cents) OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS least FROM {EVENTS} QUALIFY least >= 500"


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight line through each user's values of a day, and what it says for four hours later; by partial aggregates."""
    x = ((F.col("at_us") - 1_704_067_200_000_000) / F.lit(3.6e9)).alias("x")
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("at_us") / DAY).alias("day"), x, F.col("cents").cast("double").alias("y"))
    line = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.max("x").alias("m"))
    later = F.col("b") + F.col("a") * (F.col("m") + 4)
    return line.where("n >= 3").select("user_id", "day", "n", F.round("a", 2).alias("slope"), (later < 0).alias("runs_out"))


FORECAST = f"""
WITH e AS (SELECT user_id, at_us // {DAY} AS day, (at_us - 1704067200000000) / 3.6e9 AS x, cents::DOUBLE AS y FROM {EVENTS}),
l AS (SELECT user_id, day, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(x) AS m FROM e GROUP BY 1, 2)
SELECT user_id, day, n, round(a, 2) AS slope, b + a * (m + 4) < 0 AS runs_out FROM l WHERE n >= 3
"""


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of one series in another per user, and its alert."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", F.col("cents"))).alias("used"), F.sum("cents").alias("size"))
    share = F.coalesce("used", F.lit(0)) / F.col("size")
    return e.select("user_id", F.round(share, 6).alias("share"), F.when(share > 0.9, "critical").when(share > 0.2, "warning").alias("alert"))


CAPACITY = f"""
WITH s AS (SELECT user_id, coalesce(sum(cents) FILTER (event_type = 'view'), 0) / sum(cents) AS share FROM {EVENTS} GROUP BY 1)
SELECT user_id, round(share, 6) AS share, CASE WHEN share > 0.9 THEN 'critical' WHEN share > 0.2 THEN 'warning' END AS alert FROM s
"""


def records_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter's rate times the seconds of a day, per event type and day."""
    counter = timeseries.running_sum(events(spark, sf_dir).withColumn("one", F.lit(1)), ["event_type"], "at_us", "event_id", "one", "counter")
    rates = windowhist.counter_rate(counter, ["event_type"], "at_us", "event_id", "counter")
    out = rates.where("rate IS NOT NULL").groupBy("event_type", windowhist.in_window("at_us", DAY).alias("window_us")).agg(F.avg("rate").alias("r"))
    return out.select("event_type", "window_us", F.round(F.col("r") * 86_400, 2).alias("per_day"))


RECORDS_PER_DAY = f"""
WITH g AS (SELECT event_type, at_us, at_us - lag(at_us) OVER (PARTITION BY event_type ORDER BY at_us, event_id) AS gap FROM {EVENTS})
SELECT event_type, at_us // {DAY} * {DAY} AS window_us, round(avg(1 / (gap / 1e6)) * 86400, 2) AS per_day FROM g WHERE gap > 0 GROUP BY 1, 2
"""


def missing_or_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose latest state is not the good one, or who have no point on the last day."""
    e = events(spark, sf_dir)
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("at_us", "event_id")).alias("state"))
    day = e.select("user_id", F.floor(F.col("at_us") / DAY).alias("day"))
    newest = day.agg(F.max("day").alias("d"))
    recent = day.join(F.broadcast(newest), F.col("day") == F.col("d")).select("user_id").distinct()
    missing = last.join(recent, "user_id", "left_anti").select("user_id", F.lit("missing").alias("why"))
    return missing.unionByName(last.where("state = 'error'").select("user_id", F.lit("state").alias("why")))


MISSING_OR_CHANGED = f"""
WITH l AS (SELECT user_id, arg_max(event_type, (at_us, event_id)) AS state, max(at_us // {DAY}) AS d FROM {EVENTS} GROUP BY 1)
SELECT user_id, 'missing' AS why FROM l WHERE d < (SELECT max(d) FROM l) UNION ALL SELECT user_id, 'state' FROM l WHERE state = 'error'
"""

QUERIES = {"old_names": old_names, "inventory": inventory, "steady": steady, "forecast": forecast, "capacity": capacity, "records_per_day": records_per_day, "missing_or_changed": missing_or_changed}
ORACLES = {"old_names": OLD_NAMES_SQL, "inventory": INVENTORY, "steady": STEADY, "forecast": FORECAST, "capacity": CAPACITY, "records_per_day": RECORDS_PER_DAY, "missing_or_changed": MISSING_OR_CHANGED}
