"""Counters of what passes through a plan, collected in the same pass: rows per branch, resets and late points.

The counts of a batch are in the Observation once an action has run; those of a
stream are in the observed metrics of each micro-batch's progress, by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenloom.operators.logshape import BRANCHES

UNCLAIMED = "unclaimed"


def observe_branches(shaped: DataFrame, into: Observation | str, branches: Sequence[str] | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """``shaped`` as it is; counts its records per branch, ``unclaimed`` ones, all (``records``) and by those of ``sources`` (``source:name``).

    branches: those that may occur, by default all formats. Counting goes along
    with the action that reads the result: no second scan and no shuffle, one
    row of counts per task. Where an executor is lost, a stage before a shuffle
    may run some tasks again, and these count again; shape_counters() is exact then.
    """
    names = [b.name for b in BRANCHES] if branches is None else list(branches)
    counts = [F.count_if(F.col("branch").eqNullSafe(F.lit(n))).alias(n) for n in dict.fromkeys(names)]
    source = F.coalesce(F.col("attributes")["log.source"], F.lit("none"))
    counts += [F.count_if(source == s).alias(f"source:{s}") for s in dict.fromkeys(sources)]
    return shaped.observe(into, F.count(F.lit(1)).alias("records"), F.count_if(F.col("branch").isNull()).alias(UNCLAIMED), *counts)


def observe_rates(rates: DataFrame, into: Observation | str) -> DataFrame:
    """``rates`` (with rate and reset, as counter_rate() gives them) as they are; counts points, rated ones, resets and the rest: first points and late ones."""
    rated, reset = F.col("rate").isNotNull(), F.coalesce(F.col("reset"), F.lit(False))
    return rates.observe(into, F.count(F.lit(1)).alias("points"), F.count_if(rated).alias("rated"), F.count_if(reset).alias("resets"), F.count_if(~rated & ~reset).alias("unrated"))
