"""Tables that the library writes for itself: indexes, catalogs, logs and saved items, as Parquet in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is not set, a temporary one if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{workspace(spark)}/{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
