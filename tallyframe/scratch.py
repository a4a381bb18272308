"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, but only if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("tallyframe.scratch.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("tallyframe.scratch.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation.

    The result knows its place (scratch_path), so that `discard` can delete it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def reading(out: DataFrame, *tables: DataFrame) -> DataFrame:
    """out, which knows that it reads these tables (or what they read), so that `discard` of it deletes them."""
    out.scratch_tables = [*getattr(out, "scratch_tables", ()), *tables]
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing reads any more, not even a plan that is still to run."""
    for df in tables:
        discard(*getattr(df, "scratch_tables", ()))
        if path := getattr(df, "scratch_path", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
