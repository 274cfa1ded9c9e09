"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators.timeseries import micros
from lumenloom.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with at_us and cents, a whole number that sums up exactly."""
    return table(spark, sf_dir, "events").withColumns({"at_us": micros("ts"), "cents": F.round(F.col("value") * 100).cast("long")})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events() for work that costs more than a shuffle of its rows, which small files are dealt over all cores for."""
    return spread(events(spark, sf_dir))


#: The same in DuckDB.
EVENTS = "(SELECT *, epoch_us(ts) AS at_us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
DAY = 86_400_000_000
