"""Session settings and helpers that the jobs share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a submitting user would otherwise have to know. Sizes of shuffles are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def builder(app: str = "lumenfield") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares between driver and executors, from ``spark.checkpoint.dir``.

    Only a single-machine session may go without it; there a new temporary folder serves, once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer files than the session has cores, dealt to all cores; for costly work on each row. Tables of many files stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Rows that a task of a large shuffle aims at.
PART_ROWS = 1 << 18


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle of so many rows. Spark's own number is fixed, or follows compressed bytes: either lets a task's rows, and its memory, grow large."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative job's state in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder for a job's own tables, inside the shared folder."""
    return f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
