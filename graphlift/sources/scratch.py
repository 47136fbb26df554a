"""Folders and tables on storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """Folder on storage that every executor sees: below ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this machine may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return "/".join([base.rstrip("/"), "graphlift", *parts])


def scratch_folder(spark: SparkSession) -> str:
    return shared_folder(spark, uuid.uuid4().hex)


def scratch_table(df: DataFrame) -> DataFrame:
    """``df`` written and read back: it is computed once, and a lost executor costs no recomputation. Removed when the JVM ends."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
