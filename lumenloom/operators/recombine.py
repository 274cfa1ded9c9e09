"""Lines of one source joined to records again; exceptions marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import maps
from lumenloom.functions.cuts import before
from lumenloom.functions.patterns import matches
from lumenloom.operators.timeseries import gap_groups, running_sum

GAP_US, MAX_US, MAX_LINES, MAX_BYTES = 10_000, 80_000, 50, 1 << 16
#: Lines that hang together at most; a longer run of lines that go on with those before is cut.
MOST_LINES = 20_000


def is_exception(line: Column) -> Column:
    """A dotted name, and behind a colon what it says."""
    return before(line, ": ").rlike(r"^[A-Za-z_][\w.]*$") & ~line.contains("\n")


def recombine(df: DataFrame, key: str, at_us: str, tie: str, line: str, first_entry: str, gap_us: int = GAP_US, max_us: int = MAX_US, max_lines: int = MAX_LINES, sep: str = "\n") -> DataFrame:
    """key, at_us (of its first line), n_lines and body of each record; of the lines' own times.

    A record begins at a line that ``first_entry`` fits, after a pause of more
    than ``gap_us``, and every ``max_us`` or ``max_lines`` after its begin. Rows
    without a key or a line are records of their own.
    """
    alone = F.col(key).isNull() | (F.coalesce(F.col(line), F.lit("")) == "")
    single = df.where(alone).select(F.col(key), F.col(at_us), F.lit(1).cast("long").alias("n_lines"), F.col(line).alias("body"))
    starts = matches(F.col(line), first_entry) | (F.col(at_us) - F.col("prev_us") > gap_us)
    numbered = gap_groups(df.where(~alone).select(key, at_us, tie, line).withColumn("_one", F.lit(1)), [key], at_us, tie, starts)
    numbered = running_sum(numbered, [key], at_us, tie, "_one", "_n")
    begin = numbered.groupBy(key, "group_no").agg(F.min("_n").alias("_n0"), F.min(at_us).alias("_t0"))
    cut = numbered.join(begin, [key, "group_no"])
    piece = F.greatest(F.floor((F.col("_n") - F.col("_n0")) / max_lines), F.floor((F.col(at_us) - F.col("_t0")) / (max_us + 1)))
    lines = cut.groupBy(key, "group_no", piece.alias("_piece")).agg(F.array_sort(F.collect_list(F.struct(at_us, tie, line))).alias("_l"))
    joined = lines.select(key, F.get("_l", F.lit(0))[at_us].alias(at_us), F.size("_l").cast("long").alias("n_lines"), F.array_join(F.transform("_l", lambda x: x[line]), sep).alias("body"))
    return joined.unionByName(single)


def is_trace_start(line: Column) -> Column:
    return line.startswith("Traceback (most recent call last):") | line.startswith("Exception in thread ")


def is_chain(line: Column) -> Column:
    return line.startswith("During handling of the above exception") | line.startswith("The above exception was the direct cause")


def is_continuation(line: Column) -> Column:
    return line.rlike("^[ \t]") | line.startswith("Caused by:") | line.rlike(r"^\.\.\. \d+ more$") | is_chain(line)


def fold_traces(df: DataFrame, key: str, order: str, line: str, max_bytes: int = MAX_BYTES, most_lines: int = MOST_LINES) -> DataFrame:
    """key, order (of the first line), n_lines and body of each record, with traces folded; blank lines are left out.

    A line joins the record before it if it continues it, or if it is the
    exception line of a trace: the first since its begin or last chain line, or
    one with a message. A record is cut at each ``max_bytes``. No task holds more
    than ``most_lines`` lines of a source together: where so many go on with each
    other, what follows is a record of its own.
    """
    text = F.col(line)
    rows = df.where(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) != "").select(key, order, line)
    exception = is_exception(text) & ~is_continuation(text) & ~is_trace_start(text)
    rows = rows.withColumn("_us", F.col(order).cast("long"))
    opens = is_trace_start(text) | (~is_continuation(text) & ~exception)
    rows = gap_groups(rows, [key], "_us", order, opens, "_run", chunk_us=100_000).drop("prev_us")
    rows = running_sum(rows.withColumn("_one", F.lit(1)), [key], "_us", order, "_one", "_n", chunk_us=100_000)
    begin = rows.groupBy(key, "_run").agg(F.min("_n").alias("_n0"))
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._run") == F.col("r._run"))
    rows = rows.alias("l").join(begin.alias("r"), same).select("l.*", "r._n0")
    rows = rows.withColumn("_block", F.struct("_run", F.floor((F.col("_n") - F.col("_n0")) / most_lines).alias("part"))).drop("_one", "_n", "_n0")
    w = Window.partitionBy(key, "_block").orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_trace": F.first(is_trace_start(text)).over(so_far), "_ex": exception, "_part": F.sum(is_chain(text).cast("int")).over(so_far)})
    nth = F.sum(F.col("_ex").cast("int")).over(Window.partitionBy(key, "_block", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    breaks = F.col("_ex") & (~F.col("_trace") | ~((nth == 1) | text.contains(": ")))
    rows = rows.withColumn("_breaks", breaks)
    broken = F.max(F.col("_breaks").cast("int")).over(so_far) == 1
    rows = rows.withColumn("_breaks", F.col("_breaks") | (F.col("_ex") & broken))
    rows = rows.withColumn("_rec", F.sum(F.col("_breaks").cast("int")).over(so_far))
    inside = Window.partitionBy(key, "_block", "_rec").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cut", F.floor((F.sum(F.octet_length(text) + 1).over(inside) - 1) / max_bytes))
    lines = rows.groupBy(key, "_block", "_rec", "_cut").agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("_l"))
    return lines.select(key, F.get("_l", F.lit(0))[order].alias(order), F.size("_l").cast("long").alias("n_lines"), F.array_join(F.transform("_l", lambda x: x[line]), "\n").alias("body"))


def mark_exceptions(df: DataFrame, body: str = "body") -> DataFrame:
    """Traces become ERROR with exception.type, exception.message and exception.stacktrace."""
    text = F.regexp_replace(F.col(body), r"\n+$", "")
    last = F.substring_index(text, "\n", -1)
    is_trace = F.coalesce(is_trace_start(F.col(body)) & F.col(body).contains("\n") & is_exception(last), F.lit(False))
    values = {
        "exception.type": F.when(is_trace, F.substring_index(last, ": ", 1)),
        "exception.message": F.when(is_trace & last.contains(": "), F.regexp_extract(last, "^[^:]*: (.*)$", 1)),
        "exception.stacktrace": F.when(is_trace, F.col(body)),
    }
    base = F.col("attributes") if "attributes" in df.columns else maps.empty()
    number = F.col("severity_number") if "severity_number" in df.columns else F.lit(None).cast("int")
    return df.withColumns({"attributes": maps.overwrite(base, values), "severity_number": F.when(is_trace, 17).otherwise(number)})
