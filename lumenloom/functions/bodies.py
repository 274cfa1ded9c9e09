"""One-line bodies, and sizes and durations for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(v: Column) -> Column:
    """At most one decimal, ties to the even digit."""
    return F.regexp_replace(F.call_function("format_number", v.cast("double"), F.lit("0.0")), r"\.0$", "")


def size_text(n: Column) -> Column:
    n = n.cast("long")
    return (
        F.when(n >= 1 << 20, F.concat(one_decimal(n / F.lit(float(1 << 20))), F.lit("MiB")))
        .when(n >= 1 << 10, F.concat(one_decimal(n / F.lit(float(1 << 10))), F.lit("KiB")))
        .otherwise(F.concat(n.cast("string"), F.lit("B")))
    )


def duration_text(micros: Column) -> Column:
    us = micros.cast("long")
    minutes, rest = F.floor(us / 60_000_000), F.floor((us % 60_000_000) / 1_000_000)
    return (
        F.when((us >= 60_000_000) & (rest == 0), F.concat(minutes, F.lit("m")))
        .when(us >= 60_000_000, F.concat(minutes, F.lit("m"), rest, F.lit("s")))
        .when(us >= 1_000_000, F.concat(one_decimal(us / F.lit(1e6)), F.lit("s")))
        .when((us >= 1000) | (us == 0), F.concat(one_decimal(us / F.lit(1e3)), F.lit("ms")))
        .otherwise(F.concat(us.cast("string"), F.lit("us")))
    )


def quoted(v: Column) -> Column:
    """In double quotes where it holds a blank, a tab or a quote."""
    inner = v
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    return F.when(v.rlike('[ \t"]'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(v)


def compose(component: Column | None, text: Column, pairs: dict[str, Column] | None = None) -> Column:
    """``[component] text key=value``; empty parts are left out."""
    text = F.nullif(text, F.lit(""))
    parts = [F.when(F.nullif(component, F.lit("")).isNotNull() & text.isNotNull(), F.concat(F.lit("["), component, F.lit("]")))] if component is not None else []
    parts.append(text)
    for k, v in (pairs or {}).items():
        parts.append(F.when(F.nullif(v, F.lit("")).isNotNull(), F.concat(F.lit(f"{k}="), quoted(v))))
    return F.concat_ws(" ", *parts)


def http_line(method: Column, path: Column, status: Column, host: Column | None = None, query: Column | None = None, size: Column | None = None, micros: Column | None = None) -> Column:
    """``METHOD host/path query status size duration``; empty parts are left out."""
    target = F.concat(F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))) if host is not None else path
    parts = [F.upper(method), target]
    if query is not None:
        parts.append(query)
    parts.append(F.when(status != 0, status.cast("string")))
    if size is not None:
        parts.append(F.when(size > 0, size_text(size)))
    if micros is not None:
        parts.append(F.when(micros.isNotNull(), duration_text(micros)))
    return F.concat_ws(" ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def joined(*parts: Column) -> Column:
    """The parts that are neither null nor empty, one blank between."""
    return F.concat_ws(" ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])
