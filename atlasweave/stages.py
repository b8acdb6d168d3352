"""Intermediate tables in the shared folder that the session names, or a local one where none is set."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tables go when a session on one machine names no folder.
LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a cluster must name one, as a machine's own folder would lose rows there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL
    return base.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stage_path = path
    return found


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as a shuffle has, for costly work on rows: a file of few row groups is read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def listed(spark: SparkSession, folder: str) -> list[tuple[str, bool, int, int]]:
    """(name, whether a folder, length, time of change) of what lies in a folder, by name; nothing if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted((f.getPath().getName(), f.isDirectory(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that nothing will read again."""
    for df in frames:
        delete(df.sparkSession, df.stage_path)
