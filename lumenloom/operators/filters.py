"""Probe sampling, drop rules with their summary, blank and noise filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import cleaning
from lumenloom.functions.patterns import glob, re2

#: Paths and agents of health probes.
PROBE_PATHS = ("/healthz", "/health", "/api/health", "/probe", "/api/healthz", "/ready", "/readyz", "/livez")
PROBE_AGENTS = ("kube-probe/", "ELB-HealthChecker/", "HealthProbe", "Amazon-Route53-Health-Check-Service")


def is_probe(status: Column, path: Column, agent: Column, paths: Sequence[str] = (), agents: Sequence[str] = ()) -> Column:
    """Status 200 or 302, and a listed path (without query and one last slash) or an agent that begins as a listed one."""
    clean = F.substring_index(path, "?", 1)
    known = [*PROBE_PATHS, *paths]
    by_path = F.coalesce(clean.isin(known) | F.regexp_replace(clean, "/$", "").isin(known), F.lit(False)) & (F.coalesce(path, F.lit("")) != "")
    by_agent = F.lit(False)
    for a in [*PROBE_AGENTS, *agents]:
        by_agent = by_agent | F.coalesce(agent.startswith(a), F.lit(False))
    return F.coalesce(status.isin(200, 302), F.lit(False)) & (by_path | by_agent)


def sample_probes(df: DataFrame, probe: Column, key: Column, keep_ratio: float = 0.2) -> DataFrame:
    """Others, and a share of the probes with a constant body; which ones depends on ``key`` alone, so a rerun keeps the same.

    key: an integer; it is spread by a multiplicative hash over 0 to 999.
    """
    if not 0 <= keep_ratio <= 1:
        raise ValueError("keep_ratio must be from 0 to 1")
    draw = F.pmod(key * F.lit(2654435761), F.lit(1000))
    kept = df.withColumn("_probe", probe).where(~F.col("_probe") | (draw < keep_ratio * 1000))
    return kept.withColumns({"body": F.when(F.col("_probe"), "health probe").otherwise(F.col("body")), "sample_type": F.when(F.col("_probe"), "health_probe")}).drop("_probe")


@dataclass(frozen=True)
class DropRule:
    """All conditions that are set must hold. event_ids: numbers and ranges as ``100-200``; fields: (name, equals, ends_with)."""

    name: str
    channels: tuple[str, ...] = ()
    event_ids: tuple[str, ...] = ()
    levels: tuple[int, ...] = ()
    providers: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    tally_by: tuple[str, ...] = ()

    def condition(self) -> Column:
        out = F.lit(True)
        if self.channels:
            out = out & F.lower("channel").isin([c.lower() for c in self.channels])
        if self.event_ids:
            ids = F.lit(False)
            for e in self.event_ids:
                lo, _, hi = e.partition("-")
                ids = ids | F.col("event_id").between(int(lo), int(hi or lo))
            out = out & ids
        if self.levels:
            out = out & F.col("level").isin(list(self.levels))
        if self.providers:
            out = out & F.lower("provider").isin([p.lower() for p in self.providers])
        for name, equals, suffix in self.fields:
            v = F.lower(F.col("event_data")[name])
            out = out & (v.isin([e.lower() for e in equals]) if equals else F.lit(True)) & (v.endswith(suffix.lower()) if suffix else F.lit(True))
        return F.coalesce(out, F.lit(False))


#: Routine events that are dropped where nothing else is said.
DROP_RULES = (
    DropRule("security-audit-noise", channels=("Security",), event_ids=("4634", "4672", "5379")),
    DropRule("system-data-archiver-noise", channels=("Microsoft-Windows-SystemDataArchiver/Diagnostic",), event_ids=("2049", "2050"), levels=(4, 5)),
)


def with_drop_rule(df: DataFrame, rules: Sequence[DropRule] = DROP_RULES) -> DataFrame:
    """Adds drop_rule: the first rule whose conditions all hold, null where none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.condition(), r.name).otherwise(out)
    return df.withColumn("drop_rule", out)


def drop_events(df: DataFrame, rules: Sequence[DropRule] = DROP_RULES) -> DataFrame:
    return with_drop_rule(df, rules).where("drop_rule IS NULL").drop("drop_rule")


def drop_summary(dropped: DataFrame, fields: dict[str, Column], at_us: str = "at_us", every_us: int = 3_600_000_000, top: int = 20) -> DataFrame:
    """What a window of time has dropped: rows of window_us, drop_rule, field, value, n.

    For each rule and field the ``top`` values by count, ties to the smaller
    value, and ``other`` for the rest; missing values count as ``(missing)``.
    The field ``total`` has one row with a null value. Counting combines before
    it shuffles; ranks are taken over counts.
    """
    window = F.col(at_us) - F.pmod(F.col(at_us), F.lit(every_us))
    cells = [F.struct(F.lit("total").alias("field"), F.lit(None).cast("string").alias("value"))]
    cells += [F.struct(F.lit(n).alias("field"), F.coalesce(c.cast("string"), F.lit("(missing)")).alias("value")) for n, c in fields.items()]
    long = dropped.where("drop_rule IS NOT NULL").select(window.alias("window_us"), "drop_rule", F.explode(F.array(*cells)).alias("c")).select("window_us", "drop_rule", "c.*")
    counts = long.groupBy("window_us", "drop_rule", "field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("window_us", "drop_rule", "field").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("_r", F.row_number().over(w))
    value = F.when(F.col("_r") <= top, F.col("value")).otherwise("other")
    return ranked.groupBy("window_us", "drop_rule", "field", value.alias("value")).agg(F.sum("n").alias("n"))


def drop_blank(df: DataFrame, body: str = "body") -> DataFrame:
    """Without records of white space alone, colour codes and escapes apart; empty ones stay."""
    return df.where(~F.coalesce(cleaning.is_blank(F.col(body)), F.lit(False)))


def drop_noise(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ("error", "fail", "denied", "reject"), body: str = "body") -> DataFrame:
    """Without lines that begin as listed, unless they hold a word of ``keep`` in any case."""
    starts, wanted, low = F.lit(False), F.lit(False), F.lower(F.col(body))
    for p in prefixes:
        starts = starts | F.col(body).startswith(p)
    for k in keep:
        wanted = wanted | low.contains(k)
    return df.where(F.coalesce(~starts | wanted, F.lit(True)))


def by_globs(df: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = (), star_crosses_slash: bool = False) -> DataFrame:
    """Rows whose value one of ``include`` fits (none: all do) and none of ``exclude``."""
    fits = lambda globs: F.col(column).rlike("|".join(f"(?:{re2(glob(g, star_crosses_slash))})" for g in globs))
    out = df.where(fits(include)) if include else df
    return out.where(~fits(exclude)) if exclude else out


def routes(df: DataFrame, conditions: dict[str, Column]) -> dict[str, DataFrame]:
    """One frame per condition, and ``default`` for rows of none."""
    rest = F.lit(True)
    for c in conditions.values():
        rest = rest & ~F.coalesce(c, F.lit(False))
    return {k: df.where(c) for k, c in conditions.items()} | {"default": df.where(rest)}
