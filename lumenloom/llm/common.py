"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_ONE_MACHINE = re.compile(r"local(\[.*\])?")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share, with its scheme.

    A setting without a scheme lies in Hadoop's default file system, as Spark's
    own writers take it. Where the setting is missing, a temporary folder is made
    and set if the session is local, as in tests; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _ONE_MACHINE.fullmatch(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lumenloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = qualified(spark, f"{base.rstrip('/')}/lumenloom-{uuid.uuid4().hex}")
    atexit.register(remove, spark, path)
    return path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and place of its file system."""
    p, system = _hadoop(spark, path)
    return p.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Best effort: at the end of the process the session may be gone."""
    try:
        p, system = _hadoop(spark, path)
        system.delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def materialize(df: DataFrame, *, at: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a rerun, and
    joins on the result get exchanges of their own, which AQE can split. The
    table stays until the process ends; see Scratch for those that need not.
    """
    spark = df.sparkSession
    path = at or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job, deleted when it ends: ``with Scratch(spark) as s: t = s.write(df)``.

    What the job returns must not read them; materialize() it inside the block.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.tables])

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        table = materialize(df, at=path)
        self.tables.append((table, path))
        return table

    def drop(self, *gone: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path in [p for t, p in self.tables if any(t is g for g in gone)]:
            remove(self.spark, path)
        self.tables = [(t, p) for t, p in self.tables if not any(t is g for g in gone)]
