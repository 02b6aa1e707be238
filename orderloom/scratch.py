"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only in local mode, where one machine does all."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="orderloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def is_local(master: str) -> bool:
    """One JVM does everything (``local``, ``local[n]``), so a folder of this machine is shared by all."""
    return master == "local" or master.startswith("local[")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(df: DataFrame, sweep: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage, survives lost executors and, with ``sweep``, lets Spark drop
    the shuffle files of everything before it at once.  The files go when they
    are freed, at the latest when the JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orderloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    del df
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._settled_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; what ``settle`` didn't return is left alone."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            place, system = _place(df.sparkSession, path)
            system.delete(place, True)
