"""Table loading and shared-folder materialisation."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a folder of this
    machine is chosen and recorded in the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: cuts lineage and survives executor loss.

    Used where a result feeds several later steps.  The files live until the
    Python driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_later(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            pass  # the session has ended; the folder belongs to the cluster

    atexit.register(drop)
