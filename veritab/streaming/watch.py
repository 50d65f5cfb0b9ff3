"""File changes as a stream: each micro-batch of new files re-runs what depends on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veritab.plans.execute import run_query


def watch(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, react: Callable[[DataFrame, int], None], fmt: str = "parquet") -> StreamingQuery:
    """Calls react(rows, batch) for the rows of files that appear in folder, once for each file even after a restart."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return rows.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recheck(spark: SparkSession, pins: dict[str, tuple[str, str | None]], tables: list[str]) -> dict[str, tuple[str, str]]:
    """(state, digest) of each pin (sql, last digest): new, same, changed, or stale where the query fails or reads anything
    besides `tables`."""
    out = {}
    for name, (sql, last) in pins.items():
        try:
            now = run_query(spark, sql, tables).digest
        except Exception:
            out[name] = ("stale", last or "")
            continue
        out[name] = ("new" if last is None else "same" if now == last else "changed", now)
    return out


def windowed_totals(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Totals by event type and tumbling window under a watermark; the same code for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
