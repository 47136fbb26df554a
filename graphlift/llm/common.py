"""Reading, scratch tables and small column helpers of the text operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seconds after which the JVM knows what Python no longer holds.
LETS_GO = 1.2
#: What this Python worker keeps for its next tasks: one thing, by the function that made it and its arguments.
_kept: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one for a session on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return base.rstrip("/")


def stored(df: DataFrame, what: str, by: str | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    A column ``by`` of few values gets a folder for each. ``options`` are the writer's. The table is removed
    when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphlift-llm/{uuid.uuid4().hex}-{what}"
    df.write.options(**options).parquet(path, partitionBy=by)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(spark: SparkSession, wait: float = LETS_GO) -> None:
    """Lets Spark remove what was shuffled for tables that stand by now.

    It keeps the shuffle files of a plan until the driver's JVM finds that nobody holds the plan any more.
    Two still hold the one just written: Spark's listeners, the last plan they were told of, so they are told
    of a small one; and Python, which says what it holds no longer from a thread that looks once a second.
    """
    gc.collect()
    if wait:
        spark.sql("SELECT 1").collect()
        time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again, and what was shuffled before the last of them."""
    spark = tables[0].sparkSession
    for df in tables:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    release(spark, wait=0)


def kept(make: Callable, *args):
    """make(*args), kept by this Python worker for its next tasks until one of them keeps something else or calls ``forget``.

    Spark uses a worker again for the stages that follow, where what it has loaded would lie beside what they need.
    """
    key = (make.__module__, make.__qualname__, *args)
    if key not in _kept:
        forget()
        _kept[key] = make(*args)
    return _kept[key]


def forget() -> None:
    """Drops what this Python worker has kept and gives its memory back."""
    if _kept:
        _kept.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Gives memory that Arrow and the C library hold, but do not use, back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_of(key: Column) -> Column:
    """crc32 of a key's text; null for a null key."""
    return F.crc32(key.cast("string").cast("binary"))


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
