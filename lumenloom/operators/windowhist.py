"""Windowed summaries of metric series: rates, histograms, last values.

Windows are aligned to 1970 and go by the points' own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.maps import once
from lumenloom.operators.timeseries import DAY_US, previous

MAX_SCALE, MIN_SCALE, MAX_SIZE = 20, -10, 16
#: Ranks that the summary of a median tells apart.
ACCURACY = 10_000

_DISK = ("system.disk.pending_operations", "windows.physicaldisk.queue_length", "windows.physicaldisk.avg_queue_length", "windows.physicaldisk.operation_latency", "windows.physicaldisk.idle_time")
_PLAIN = (
    "system.cpu.time", "system.cpu.load_average.1m", "system.cpu.load_average.5m", "system.cpu.load_average.15m", "system.cpu.load_average.normalized.1m",
    "system.cpu.load_average.normalized.5m", "system.cpu.load_average.normalized.15m", "system.disk.io_time", "system.disk.weighted_io_time", "system.disk.operation_time",
    "system.disk.merged", "system.paging.usage", "system.paging.utilization", "system.paging.operations", "system.paging.faults", "system.network.connections",
    "windows.memory.committed", "windows.memory.commit_limit", "hw.gpu.io", "hw.errors",
)
_PROCESS = ("process.cpu.time", "process.cpu.utilization", "process.cpu.utilization.percpu", "process.memory.usage", "process.memory.virtual", "process.disk.io", "process.threads", "process.handles")
#: Group -> (mode, counters are made rates, metrics).
CATALOGUE: dict[str, tuple[str, bool, tuple[str, ...]]] = {
    "cpu": ("histogram", False, ("system.cpu.utilization", "system.cpu.utilization.percpu")),
    "memory": ("histogram", False, ("system.memory.usage", "system.memory.utilization")),
    "disk_latency": ("histogram", False, _DISK),
    "disk_io_rate": ("histogram", True, ("system.disk.io", "system.disk.operations", "windows.physicaldisk.io", "windows.physicaldisk.transfers")),
    "network_rate": ("histogram", True, ("system.network.io", "system.network.packets", "system.network.errors", "system.network.dropped")),
    "cpu_pressure": ("histogram", False, ("windows.system.processor_queue_length",)),
    "memory_pages": ("histogram", False, ("windows.memory.pages",)),
    "network_pressure": ("histogram", False, ("windows.tcp.retransmitted_segments", "windows.network_interface.output_queue_length")),
    "gpu": ("histogram", False, ("hw.gpu.utilization", "hw.gpu.memory.utilization", "hw.temperature", "hw.power")),
    "psi": ("last", False, tuple(f"system.pressure.{r}.{k}.{w}" for r in ("cpu", "memory", "io") for k in ("some", "full") for w in ("avg10", "avg60", "avg300"))),
    "process": ("last", False, _PROCESS),
    "filesystem": ("last", False, ("system.filesystem.usage", "system.filesystem.utilization")),
    "plain": ("last", False, _PLAIN),
}


def routed(points: DataFrame, groups: list[str] | None = None, metric: str = "metric") -> DataFrame:
    """Adds group and mode by the metric's name; null where no group has it, and such points pass the windows by."""
    group, mode = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (how, _, metrics) in CATALOGUE.items():
        if groups is None or name in groups:
            group = F.when(F.col(metric).isin(*metrics), name).otherwise(group)
            mode = F.when(F.col(metric).isin(*metrics), how).otherwise(mode)
    return points.withColumns({"group": group, "mode": mode})


def summaries(points: DataFrame, series: list[str], at_us: str, tie: str, value: str, every_us: int = DAY_US, groups: list[str] | None = None, keep_counter: bool = False) -> dict[str, DataFrame]:
    """Points by what the catalogue says of their metric: ``histogram``, ``last``, ``counter`` and ``rest``.

    Histograms are of values, or of rates where the group's counters are made
    rates; with ``keep_counter`` such counters also give their last reading of
    each window, else ``counter`` is empty. Points of no group pass in ``rest``.
    series: columns that tell series of one metric apart; the metric is ``metric``.
    """
    keys = ["metric", *series]
    known = routed(points, groups)
    counters = [m for _, is_counter, metrics in CATALOGUE.values() if is_counter for m in metrics]
    made_rate = F.col("metric").isin(counters)
    rates = counter_rate(known.where((F.col("mode") == "histogram") & made_rate), keys, at_us, tie, value).where("rate IS NOT NULL").withColumn(value, F.col("rate").cast("double"))
    plain = known.where((F.col("mode") == "histogram") & ~made_rate).withColumn(value, F.col(value).cast("double"))
    names = [*keys, at_us, value]
    last = lambda df: last_values(df, keys, at_us, tie, [value], every_us)
    return {
        "histogram": exponential_histogram(finite(plain.select(*names).unionByName(rates.select(*names)), value), keys, value, at_us, every_us),
        "last": last(known.where(F.col("mode") == "last")),
        "counter": last(known.where((F.col("mode") == "histogram") & made_rate & F.lit(keep_counter))),
        "rest": known.where("mode IS NULL").select(*points.columns),
    }


def finite(points: DataFrame, value: str) -> DataFrame:
    """Without null, NaN and infinite values."""
    v = F.col(value)
    return points.where(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))


def counter_rate(points: DataFrame, series: list[str], at_us: str, tie: str, value: str, start: str | None = None, idle_us: int | None = None, chunk_us: int = DAY_US) -> DataFrame:
    """Adds rate, the counter's increase per second since the series' point before, and reset.

    A series' first point, a point not later than the one before, a fall of the
    counter and a changed ``start`` have no rate; the latter two set reset.
    After a pause of ``idle_us`` or more the next point counts as a first one.
    """
    what = {"_v": value, "_t": at_us, **({"_s": start} if start else {})}
    df = previous(points, series, at_us, tie, what, chunk_us)
    gap, step = F.col(at_us) - F.col("_t"), F.col(value) - F.col("_v")
    restarted = ~F.col("_s").eqNullSafe(F.col(start)) if start else F.lit(False)
    fresh = F.col("_t").isNull() | ((gap >= idle_us) if idle_us else F.lit(False))
    reset = F.coalesce(~fresh & (restarted | (step < 0)), F.lit(False))
    rate = F.when(~fresh & ~reset & (gap > 0), step / (gap / F.lit(1e6)))
    return df.withColumns({"rate": rate, "reset": reset}).drop(*what)


def odd_spacing(points: DataFrame, series: list[str], at_us: str, tie: str, every_us: int, chunk_us: int = DAY_US) -> DataFrame:
    """n_gaps and n_odd per series: gaps, and those further from ``every_us`` than half of it."""
    df = previous(points, series, at_us, tie, {"_t": at_us}, chunk_us).where("_t IS NOT NULL")
    odd = F.abs(F.col(at_us) - F.col("_t") - every_us) * 2 > every_us
    return df.groupBy(*series).agg(F.count("*").alias("n_gaps"), F.sum(odd.cast("long")).alias("n_odd"))


def in_window(at_us: str, every_us: int) -> Column:
    """The start of the window of a time, in microseconds."""
    return F.col(at_us) - F.pmod(F.col(at_us), F.lit(every_us))


def window_stats(points: DataFrame, series: list[str], value: str, at_us: str, every_us: int = DAY_US) -> DataFrame:
    """n, sum, least and greatest of the values per series and window; partial sums before the one shuffle."""
    return (
        points.where(F.col(value).isNotNull())
        .groupBy(*series, in_window(at_us, every_us).alias("window_us"))
        .agg(F.count(value).alias("n"), F.sum(value).alias("sum_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    )


def last_values(points: DataFrame, series: list[str], at_us: str, arrival: str, columns: list[str], every_us: int = DAY_US) -> DataFrame:
    """The window's last point per series: the latest time, of one time the latest arrival."""
    row = F.struct(*columns)
    return (
        points.groupBy(*series, in_window(at_us, every_us).alias("window_us"))
        .agg(F.max_by(row, F.struct(at_us, arrival)).alias("_r"))
        .select(*series, "window_us", "_r.*")
    )


def drop_late(points: DataFrame, at_us: str, seen_us: str, every_us: int) -> DataFrame:
    """Without points that are older than the window before the one in which they were seen."""
    return points.where(F.col(at_us) >= in_window(seen_us, every_us) - every_us)


def bucket(v: Column, scale: Column) -> Column:
    """Index of the base-2 exponential bucket of |v| > 0, upper bound inclusive: ceil(log2(|v|) * 2^scale) - 1."""
    return (F.ceil(F.round(F.log2(F.abs(v)) * F.pow(F.lit(2.0), scale), 9)) - 1).cast("long")


def _scale(least: Column, greatest: Column, max_size: int) -> Column:
    """The largest scale at which the span of the two has at most ``max_size`` buckets; the largest of all where one is null."""
    out = F.lit(MIN_SCALE)
    for s in range(MIN_SCALE, MAX_SCALE + 1):
        fits = bucket(greatest, F.lit(s)) - bucket(least, F.lit(s)) < max_size
        out = F.when(F.coalesce(fits, F.lit(True)), F.lit(s)).otherwise(out)
    return out


def exponential_histogram(points: DataFrame, series: list[str], value: str, at_us: str, every_us: int = DAY_US, max_size: int = MAX_SIZE) -> DataFrame:
    """window_us, count, sum, min, max, scale, zero_count, positive and negative (offset, counts) per series and window.

    One aggregate finds the range of each window's values, whose scale is then
    joined to the points; a second counts by bucket. Both combine before they
    shuffle, so that a hot series costs each task a row per bucket.
    """
    keys = [*series, "window_us"]
    ranges, counted = _ranges_and_counts(points, series, value, at_us, every_us, max_size)
    return _as_histograms(ranges, counted, keys)


def _ranges_and_counts(points: DataFrame, series: list[str], value: str, at_us: str, every_us: int, max_size: int) -> tuple[DataFrame, DataFrame]:
    """Per series and window: counts, ranges of either sign and scale; and the counts (_c) of its buckets (_pos, _i)."""
    if not 2 <= max_size <= 160:
        raise ValueError("max_size must be from 2 to 160")
    df = finite(points, value).withColumn("window_us", in_window(at_us, every_us)).withColumn("_v", F.col(value).cast("double"))
    keys = [*series, "window_us"]
    size = F.abs("_v")
    side = lambda cond, f: f(F.when(cond, size))
    pos, neg = F.col("_v") > 0, F.col("_v") < 0
    ranges = df.groupBy(*keys).agg(
        F.count("*").alias("count"), F.sum("_v").alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.count(F.when(F.col("_v") == 0, 1)).alias("zero_count"),
        side(pos, F.min).alias("_pl"), side(pos, F.max).alias("_ph"), side(neg, F.min).alias("_nl"), side(neg, F.max).alias("_nh"),
    )
    ranges = ranges.withColumn("scale", F.least(_scale(F.col("_pl"), F.col("_ph"), max_size), _scale(F.col("_nl"), F.col("_nh"), max_size)))
    scaled = df.where("_v <> 0").alias("l").join(ranges.select(*keys, "scale").alias("r"), _same(keys, "l", "r")).select("l.*", "r.scale")
    counted = scaled.groupBy(*keys, "scale", pos.alias("_pos"), bucket(F.col("_v"), F.col("scale")).alias("_i")).agg(F.count("*").alias("_c"))
    return ranges, counted


def _same(keys: list[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _as_histograms(ranges: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """A row per row of ``ranges`` with its buckets."""
    spread = counted.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("_pos") == p, F.struct("_i", "_c")))).alias(n) for n, p in (("_p", True), ("_n", False))])
    both = ranges.alias("a").join(spread.alias("b"), _same(keys, "a", "b"), "left").select("a.*", "b._p", "b._n")

    def buckets(m: str) -> Column:
        ks = F.map_keys(m)
        lo, hi = F.array_min(ks), F.array_max(ks)
        counts = F.transform(F.sequence(lo, hi), lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0).cast("long")))
        return F.when(F.size(m) > 0, F.struct(lo.alias("offset"), counts.alias("counts")))

    return both.select(*keys, "count", "sum", "min", "max", "scale", "zero_count", buckets("_p").alias("positive"), buckets("_n").alias("negative"))


def cumulative_histogram(points: DataFrame, series: list[str], value: str, at_us: str, every_us: int = DAY_US, max_size: int = MAX_SIZE) -> DataFrame:
    """As exponential_histogram(), but each window's row counts all of its series' points up to the window's end.

    Windows are counted first, each at its own scale. The scale of a sum falls as
    its range grows; windows of one scale form a step, for which the buckets of
    all windows before are merged once, pairwise into those of the lower scale,
    and then run on. So a series costs each step its buckets and windows, not all
    pairs of windows.
    """
    keys = [*series, "window_us"]
    ranges, counted = _ranges_and_counts(points, series, value, at_us, every_us, max_size)
    w = Window.partitionBy(*series).orderBy("window_us").rowsBetween(Window.unboundedPreceding, 0)
    run = {c: F.sum(c).over(w) for c in ("count", "sum", "zero_count")} | {c: F.min(c).over(w) for c in ("min", "_pl", "_nl")} | {c: F.max(c).over(w) for c in ("max", "_ph", "_nh")}
    total = ranges.select(*keys, *[v.alias(c) for c, v in run.items()])
    # Joins go by the scale: as a column of its own its long expression stays out of what the optimizer infers from them.
    total = once(total, {"scale": F.least(_scale(F.col("_pl"), F.col("_ph"), max_size), _scale(F.col("_nl"), F.col("_nh"), max_size))})
    steps = total.groupBy(*series, F.col("scale").alias("_to")).agg(F.min("window_us").alias("_from_us"), F.max("window_us").alias("_to_us"))
    both = counted.alias("l").join(steps.alias("r"), _same(series, "l", "r") & (F.col("l.window_us") <= F.col("r._to_us"))).select("l.*", "r._to", "r._from_us")
    merged = F.floor(F.col("_i") / F.pow(F.lit(2.0), F.col("scale") - F.col("_to"))).cast("long")
    cell = [*series, "_to", "_pos", "_i"]
    moved = both.select(*series, "_to", "_pos", merged.alias("_i"), F.greatest("window_us", "_from_us").alias("window_us"), "_c")
    moved = moved.groupBy(*cell, "window_us").agg(F.sum("_c").alias("_c"))
    windows = total.select(*keys, F.col("scale").alias("_to"))
    on = [*series, "_to"]
    grid = windows.alias("l").join(moved.select(*cell).distinct().alias("r"), _same(on, "l", "r")).select("l.*", "r._pos", "r._i")
    filled = grid.alias("l").join(moved.alias("r"), _same([*cell, "window_us"], "l", "r"), "left").select("l.*", "r._c")
    so_far = F.sum("_c").over(Window.partitionBy(*cell).orderBy("window_us").rowsBetween(Window.unboundedPreceding, 0))
    return _as_histograms(total, filled.withColumn("_c", so_far).where("_c > 0"), keys)


def cumulative(windows: DataFrame, series: list[str]) -> DataFrame:
    """Window statistics summed up since each series began; of one row per window, so a series' rows are few."""
    w = Window.partitionBy(*series).orderBy("window_us").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumns({"n": F.sum("n").over(w), "sum_value": F.sum("sum_value").over(w), "min_value": F.min("min_value").over(w), "max_value": F.max("max_value").over(w)})


def _order(value: Column) -> Column:
    """A whole number that does not fall as the value grows; values of one number are within 1 / 700 of each other."""
    size = F.ceil(F.log2(F.abs(value)) * 512).cast("long") + (1 << 20)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def medians(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and p50: the exact median of each group, between the two middle values if their number is even; nulls are left out.

    Equal values are counted first. Ranges of values tell in which of them the
    middle lies, and only that range's values are put in order, so that no task
    sorts a whole group.
    """
    df = points.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", _order(F.col("_v")))
    ranges = counts.groupBy(*keys, "_o").agg(F.sum("_c").alias("_c"))
    up_to = Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumns({"_end": F.sum("_c").over(up_to), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    ranges = ranges.withColumns({"_lo": F.expr("(_n + 1) div 2"), "_hi": F.expr("_n div 2 + 1"), "_begin": F.col("_end") - F.col("_c")})
    middle = ranges.where("_end >= _lo AND _begin < _hi").select(*keys, "_o", "_begin", "_lo", "_hi")
    near = counts.alias("l").join(middle.alias("r"), _same([*keys, "_o"], "l", "r")).select("l.*", "r._begin", "r._lo", "r._hi")
    inside = Window.partitionBy(*keys, "_o").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_begin") + F.sum("_c").over(inside))
    at = lambda rank: F.min(F.when(F.col("_end") >= F.col(rank), F.col("_v")))
    return near.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias("p50"))


def aligned_stats(points: DataFrame, series: list[str], value: str, at_us: str, period_us: int, median: str | None = "exact") -> DataFrame:
    """One row per series, period and statistic: min, max, mean, sum, count and, unless ``median`` is None, p50.

    median: "exact" as medians() has it; "summary" takes a value of the group by
    mergeable summaries of bounded size, within a share of 1 / ACCURACY of the ranks.
    """
    keys = [*series, "period_us"]
    points = points.withColumn("period_us", in_window(at_us, period_us))
    aggs = [F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), F.avg(value).alias("mean"), F.sum(value).cast("double").alias("sum"), F.count(value).cast("double").alias("count")]
    names = ["min", "max", "mean", "sum", "count"]
    if median == "summary":
        aggs.append(F.percentile_approx(value, F.lit(0.5), F.lit(ACCURACY)).cast("double").alias("p50"))
    wide = points.groupBy(*keys).agg(*aggs)
    if median == "exact":
        wide = wide.alias("l").join(medians(points, keys, value).alias("r"), _same(keys, "l", "r"), "left").select("l.*", "r.p50")
    return wide.unpivot(keys, names + (["p50"] if median else []), "stat", "value")


def missed_windows(state: DataFrame, now_us: Column, period_us: int, delay_us: int, max_catchup: int) -> DataFrame:
    """window_start_us and window_end_us of the windows that are due since last_end_us (null: none yet), newest ``max_catchup`` at most."""
    due = now_us - delay_us
    end = due - F.pmod(due, F.lit(period_us))
    first = F.greatest(F.coalesce(F.col("last_end_us"), end - period_us), end - period_us * max_catchup)
    starts = F.when(first <= end - period_us, F.sequence(first, end - period_us, F.lit(period_us)))
    return state.withColumn("window_start_us", F.explode(starts)).withColumn("window_end_us", F.col("window_start_us") + period_us)
