"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table of the schema's size that the driver keeps; a larger one is written to the shared folder.
KEPT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own on this machine is made, set, and
    deleted at the end - in local mode only: executors elsewhere can't see it,
    so on a cluster this is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shapewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where if ":" in where.split("/", 1)[0] else f"file://{where}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shapewright/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A path for a table of this application."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables and archives. DataFrames
    that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: a short plan, and nothing that a lost executor could
    take along. For tables of the schema's size: up to KEPT rows come to the
    driver; a larger table is written to the shared folder and read again."""
    few = df.limit(KEPT + 1).toArrow()
    if few.num_rows <= KEPT:
        return df.sparkSession.createDataFrame(few, df.schema)
    return stored(df, "model")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: for tables of the
    data's size that several plans use."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
