"""Points of many like processes summed up as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.timeseries import gap_groups

SCRAPE_GAP_US = 1_000_000
#: Times are put in order within chunks of so long; a chunk gives one row to the next.
CHUNK_US = 60_000_000
#: Resource keys that differ for each process.
OWN_KEYS = ("process.pid", "process.parent_pid", "process.command", "process.command_line", "process.executable.path", "process.owner", "process.executable.name")


def scrape_ends(points: DataFrame, at_us: str = "at_us", gap_us: int = SCRAPE_GAP_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """at_us and scrape_us: for each distinct time the last one of its scrape; a pause of ``gap_us`` or more begins a new scrape.

    Scrapes are of all series, so times have no key but their chunk of ``chunk_us``.
    """
    times = points.select(at_us).distinct().withColumn("_tie", F.col(at_us))
    runs = gap_groups(times, [], at_us, "_tie", F.col(at_us) - F.col("prev_us") >= gap_us, "_run", chunk_us)
    ends = runs.groupBy("_run").agg(F.max(at_us).alias("scrape_us"))
    return runs.join(ends, "_run").select(at_us, "scrape_us")


def common_attributes(points: DataFrame, name: str, resource: str = "resource") -> DataFrame:
    """name and common: the resource entries that all its points share, per-process ones left out."""
    kept = F.map_filter(F.col(resource), lambda k, _: ~k.isin(*OWN_KEYS))
    total = points.groupBy(name).agg(F.count("*").alias("_all"))
    each = points.select(name, F.explode(kept).alias("k", "v")).groupBy(name, "k", "v").agg(F.count("*").alias("n"))
    shared = each.join(total, name).where("n = _all").groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("common"))
    return total.join(shared, name, "left").select(name, F.coalesce("common", F.create_map().cast("map<string,string>")).alias("common"))


def sum_processes(points: DataFrame, matching: Column, name: str, keys: list[str], at_us: str = "at_us") -> DataFrame:
    """One point per name, keys and scrape for the points that ``matching`` holds for; others pass unchanged.

    points: metric, kind, temporality, monotonic, value_int, value_double,
    start_us and at_us. Whole numbers stay whole unless one of the summands is
    not. The start is the earliest that is set, the time the scrape's last. A
    cumulative sum becomes non-monotonic, as processes end. Ages, histograms
    and points without a value are left out.
    """
    own = points.where(F.coalesce(matching, F.lit(False)))
    rest = points.where(~F.coalesce(matching, F.lit(False)))
    usable = own.where((F.col("metric") != "process.uptime") & F.col("kind").isin("sum", "gauge") & F.coalesce("value_int", "value_double").isNotNull())
    timed = usable.join(scrape_ends(own, at_us), at_us)
    whole = F.sum("value_int")
    any_double = F.max(F.col("value_double").isNotNull())
    out = timed.groupBy(name, *keys, "metric", "kind", "temporality", "scrape_us").agg(
        F.when(~any_double, whole).alias("value_int"),
        F.when(any_double, F.coalesce(F.sum("value_double"), F.lit(0.0)) + F.coalesce(whole, F.lit(0)).cast("double")).alias("value_double"),
        F.min(F.when(F.col("start_us") != 0, F.col("start_us"))).alias("start_us"),
        F.max("monotonic").alias("monotonic"),
    )
    out = out.withColumn("monotonic", F.col("monotonic") & ~F.coalesce((F.col("kind") == "sum") & (F.col("temporality") == "cumulative"), F.lit(False))).withColumnRenamed("scrape_us", at_us)
    return rest.unionByName(out, allowMissingColumns=True)
