"""Cutting the lineage of a result that several later steps read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the session's checkpoint folder.

    The cluster names a shared folder in `spark.checkpoint.dir`, so what is written survives
    lost executors. Where none is named, only a session whose executors are threads of the driver
    gets a temporary folder; any other is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fleetfacts-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "staged") -> DataFrame:
    """Compute `df` once, now, as a written table, and read it from there.

    Later steps plan on the table's measured size.
    """
    spark = df.sparkSession
    path = staging_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
