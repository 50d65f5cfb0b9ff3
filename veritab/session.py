"""Sessions with the settings that the library's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; settings are given by name with dots as double underscores."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
