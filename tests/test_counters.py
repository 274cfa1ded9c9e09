"""Counts of the same pass are those of an aggregate, in batches and streams; the rows are not changed."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from lumenloom.operators import counters, windowhist
from lumenloom.operators.logshape import shape_counters
from lumenloom.plans.common import events

SF = "/root/testdata/sf0.001"


def shaped(spark):
    e = events(spark, SF)
    branch = F.when(F.col("event_id") % 3 == 0, "klog").when(F.col("event_id") % 3 == 1, "redis")
    source = F.when(F.col("event_id") % 5 == 0, F.lit("kubernetes"))
    return e.select("event_id", branch.alias("branch"), F.create_map(F.lit("log.source"), source).alias("attributes"))


def test_batch(spark, tmp_path):
    df, seen = shaped(spark), Observation()
    counters.observe_branches(df, seen, sources=("kubernetes", "none")).write.parquet(str(tmp_path / "out"))
    got, want = seen.get, {}
    for r in shape_counters(df).collect():
        for k in (r.branch or counters.UNCLAIMED, f"source:{r.source}", "records"):
            want[k] = want.get(k, 0) + r.records
    assert {k: n for k, n in got.items() if n} == want and got["nginx"] == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count() == got["records"]


def test_plan_has_one_scan_and_no_shuffle(spark):
    plan = counters.observe_branches(shaped(spark), Observation())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and "CollectMetrics" in plan


def test_empty(spark):
    seen = Observation()
    assert counters.observe_branches(shaped(spark).limit(0), seen, ["klog"]).collect() == []
    assert seen.get == {"records": 0, "unclaimed": 0, "klog": 0}


def test_stream(spark, tmp_path):
    shaped(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(shaped(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counters.observe_branches(live, "shapes", ["klog", "redis"]).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120) and q.exception() is None
    rows = [p["observedMetrics"]["shapes"] for p in q.recentProgress if p["numInputRows"]]
    assert len(rows) == 2
    want = {r.branch or "unclaimed": r["count"] for r in shaped(spark).groupBy("branch").count().collect()}
    assert {k: sum(r[k] for r in rows) for k in ("klog", "redis", "unclaimed")} == want


def test_rates(spark):
    points = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1_000_000, 1, 3.0), ("a", 2_000_000, 2, 1.0), ("b", 5, 3, 7.0)], "k string, t long, i long, v double")
    seen = Observation()
    assert counters.observe_rates(windowhist.counter_rate(points, ["k"], "t", "i", "v"), seen).count() == 4
    assert seen.get == {"points": 4, "rated": 1, "resets": 1, "unrated": 2}
