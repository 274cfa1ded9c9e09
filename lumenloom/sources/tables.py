"""Tables as operators read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, if its source has fewer splits than there are cores; else as it is.

    df: a scan with projections and filters. A row group is one task, so a small
    file keeps one core busy. A large source has splits enough, and is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, or a temporary one of a local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lumenloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lumenloom-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
