"""Looking back along a series without gathering it in one task.

A series may hold a third of all points. Each function here cuts a series into
chunks of time, works within chunks, and carries one row per chunk over to the
next; only those rows meet by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp, with or without a zone, as if it were in UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    ntz = c.cast("timestamp_ntz")
    days = F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY_US + (F.hour(ntz) * 3600 + F.minute(ntz) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ntz) * 1_000_000).cast("long")


def previous(df: DataFrame, series: list[str], at_us: str, tie: str, what: dict[str, str], chunk_us: int = DAY_US) -> DataFrame:
    """Adds each value of ``what`` (new name -> column) as the series' point before has it; null at its first point.

    at_us: a long column of microseconds; tie: a column that orders points of
    one time. Two shuffles by (series, chunk), one of chunk rows by series.
    Points without a time come first, in a chunk of their own.
    """
    df = df.withColumn("_chunk", F.floor(F.col(at_us) / chunk_us))
    keys = [*series, "_chunk"]
    row = F.struct(*[F.col(c).alias(n) for n, c in what.items()])
    last = df.groupBy(*keys).agg(F.max_by(row, F.struct(at_us, tie)).alias("_last"))
    carried = last.select(*keys, F.lag("_last").over(Window.partitionBy(*series).orderBy("_chunk")).alias("_carried"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = df.alias("l").join(carried.alias("r"), cond, "left").select("l.*", "r._carried")
    w = Window.partitionBy(*keys).orderBy(at_us, tie)
    found = F.coalesce(F.lag(row).over(w), F.col("_carried"))
    out = joined.withColumn("_before", found)
    return out.select(*[c for c in df.columns if c != "_chunk"], *[F.col(f"_before.{n}").alias(n) for n in what])


def running_sum(df: DataFrame, series: list[str], at_us: str, tie: str, value: str, name: str, chunk_us: int = DAY_US) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the series up to and with each point."""
    df = df.withColumn("_chunk", F.floor(F.col(at_us) / chunk_us))
    keys = [*series, "_chunk"]
    total = df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_t"))
    w = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*keys, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_b"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = df.alias("l").join(before.alias("r"), cond, "left").select("l.*", "r._b")
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(at_us, tie).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(name, F.col("_b") + F.coalesce(inside, F.lit(0))).drop("_chunk", "_b")


def gap_groups(df: DataFrame, series: list[str], at_us: str, tie: str, starts: Column, name: str = "group_no", chunk_us: int = DAY_US, back: dict[str, str] | None = None) -> DataFrame:
    """Adds ``name``, the number of the run that a point belongs to, from 1.

    starts: a condition over the point's columns and prev_us, the time of the
    point before (null at the first), and what ``back`` adds; where it holds or
    prev_us is null, a new run begins.
    """
    with_prev = previous(df, series, at_us, tie, {"prev_us": at_us, **(back or {})}, chunk_us)
    flag = F.when(F.col("prev_us").isNull() | starts, 1).otherwise(0)
    return running_sum(with_prev.withColumn("_start", flag), series, at_us, tie, "_start", name, chunk_us).drop("_start")


def changes(df: DataFrame, series: list[str], at_us: str, tie: str, value: str, chunk_us: int = DAY_US) -> DataFrame:
    """The points at which a series' value first appears or differs from the one before; adds previous_value."""
    out = previous(df, series, at_us, tie, {"previous_value": value, "_seen": at_us}, chunk_us)
    return out.where(F.col("_seen").isNull() | ~F.col("previous_value").eqNullSafe(F.col(value))).drop("_seen")


def reset_start(df: DataFrame, series: list[str], at_us: str, tie: str, value: str, boot_us: str | None = None, chunk_us: int = DAY_US) -> DataFrame:
    """Adds start_us, from when a counter counts: its boot time, or the point at which it last fell.

    Without boot_us the first point of the series.
    """
    with_prev = previous(df, series, at_us, tie, {"_v": value, "_t": at_us}, chunk_us)
    fell = F.when(F.col("_v") > F.col(value), F.col(at_us)).when(F.col("_t").isNull(), F.col(boot_us) if boot_us else F.col(at_us))
    marked = with_prev.withColumn("_reset", fell).drop("_v", "_t").withColumn("_chunk", F.floor(F.col(at_us) / chunk_us))
    keys = [*series, "_chunk"]
    last = marked.groupBy(*keys).agg(F.max_by("_reset", F.when(F.col("_reset").isNotNull(), F.struct(at_us, tie))).alias("_r"))
    w = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, F.last("_r", ignorenulls=True).over(w).alias("_b"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = marked.alias("l").join(before.alias("r"), cond, "left").select("l.*", "r._b")
    inside = F.last("_reset", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at_us, tie).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("start_us", F.coalesce(inside, F.col("_b"))).drop("_chunk", "_b", "_reset")


def reset_proof(df: DataFrame, series: list[str], at_us: str, tie: str, value: str, name: str = "total", chunk_us: int = DAY_US) -> DataFrame:
    """Adds a counter that goes on when its source falls back: it starts at 0, grows by each increase, and by the new reading after a fall."""
    step = F.when(F.col("_v").isNull(), 0).when(F.col(value) >= F.col("_v"), F.col(value) - F.col("_v")).otherwise(F.col(value))
    out = previous(df, series, at_us, tie, {"_v": value}, chunk_us).withColumn("_step", step)
    return running_sum(out, series, at_us, tie, "_step", name, chunk_us).drop("_v", "_step")


def volume(df: DataFrame, series: list[str], at_us: str, tie: str, rate_kb: str, max_gap_us: int, name: str = "bytes", chunk_us: int = DAY_US) -> DataFrame:
    """Adds bytes carried so far at ``rate_kb`` KiB a second over the time since the point before; longer gaps than max_gap_us add nothing."""
    gap = F.col(at_us) - F.col("_t")
    # Whole rates are summed up as whole numbers, and divided once.
    step = F.when((gap > 0) & (gap <= max_gap_us), F.col(rate_kb) * 1024 * gap).otherwise(0)
    out = previous(df, series, at_us, tie, {"_t": at_us}, chunk_us).withColumn("_step", step)
    return running_sum(out, series, at_us, tie, "_step", name, chunk_us).withColumn(name, F.col(name) / 1e6).drop("_t", "_step")


def capped(df: DataFrame, group: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in this order.

    Each partition first keeps its own first rows of a group, so a group's rows
    meet only ``most`` per partition at a time.
    """
    w = Window.partitionBy(*group, "_part").orderBy(*order)
    kept = df.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    last = Window.partitionBy(*group).orderBy(*order)
    return kept.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).drop("_part", "_n")


def sorted_cap(df: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of all."""
    return df.orderBy(*order).limit(most)
