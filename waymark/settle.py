"""Settled tables: steps that several later ones read, written once to the folder that all executors share.

A settled table cuts lineage, outlives lost executors and gives Catalyst true sizes and short plans. The folder
is the session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder. The driver's
JVM removes what is left when it ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {context.master})")
        top = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", top)
        atexit.register(shutil.rmtree, top.removeprefix("file://"), ignore_errors=True)
    folder = f"{top.rstrip('/')}/waymark-engine-{context.applicationId}"
    if getattr(context, "_waymark_engine_folder", None) != folder:
        target, files = _hadoop_path(spark, folder)
        files.mkdirs(target)
        files.deleteOnExit(target)
        context._waymark_engine_folder = folder
    return folder


def settle(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """df, written and read back; its path is added to ``held``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    # the step's plans, their event texts and its shuffles are garbage now; the driver gives that memory back before the next step
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def by_address(df: DataFrame) -> DataFrame:
    """df for a join on addr_id, which is sorted and merged. Such tables grow with the input, and Catalyst takes their compressed files for less than they are in memory, so a guess must not send them through the driver."""
    return df.hint("merge")


def release(rows: DataFrame) -> None:
    """Removes the settled tables that made ``rows`` (listed in its ``held``), once the rows are written."""
    for path in getattr(rows, "held", []):
        target, files = _hadoop_path(rows.sparkSession, path)
        files.delete(target, True)
