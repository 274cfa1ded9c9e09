"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import Scratch, materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = materialize, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each end of an edge.

    edges: two long columns ``u`` and ``v``; direction, repeats and loops do not
    matter, rows with a null end are ignored. Returns ``id``, ``component`` for
    each id on an edge, as a table that ``keep`` writes. Alternates large-star
    and small-star steps; each step joins edges with per-vertex minima, both
    read from written tables, so that a hub's rows are split by AQE instead of
    meeting in one task. The rounds grow with the logarithm of the longest path;
    a round's tables are deleted after the next. An empty table gives no rows.
    """
    with Scratch(edges.sparkSession) as tables:
        e = tables.write(
            edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        before = _digest(e)
        for _ in range(max_rounds if before[0] else 0):
            # Large star: neighbours above a vertex move to the least of its closed neighbourhood.
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = tables.write(large)
            tables.drop(e, least)
            # Small star: lower neighbours and the vertex itself meet at the least of them.
            least = tables.write(large.groupBy("u").agg(F.min("v").alias("m")))
            small = (
                large.join(least, "u")
                .where("v <> m")
                .select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select("u", F.col("m").alias("v")))
                .distinct()
            )
            e = tables.write(small)
            tables.drop(large, least)
            after = _digest(e)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
        return keep(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
