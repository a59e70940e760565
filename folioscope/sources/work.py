"""The folder for tables that operators keep between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 16 << 20


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which executors share; nothing is made there yet.

    A local session without that setting gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/folioscope/{label}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they are in fewer partitions than that, as those of one small file are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parts_for(rows: DataFrame, column: str) -> int:
    """How many partitions ``rows`` take for about ``PART`` bytes of a text column in each; no fewer than the session's own for a shuffle."""
    spark = rows.sparkSession
    held = rows.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART))


def kept(rows: DataFrame, label: str) -> DataFrame:
    """``rows``, written once and read back: later steps start from the table, also after an executor is lost."""
    path = work_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
