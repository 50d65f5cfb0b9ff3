"""Type-ahead ranking: past questions and items of a tree against what has been typed, as score expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scores.
PREFIX_QUESTION = 1000
PREFIX_NAME = 2000
WITHIN_NAME = 1000
QUALITY = 100
RECENCY = 40
FREQUENCY = 20
PINNED_ONLY = 20
HALF_LIFE_MS = 604_800_000
QUESTIONS = 6
ITEMS = 12


def tightness(typed: str, text: Column) -> Column:
    """Typed characters over the width of the first window that has them in order; null where none has.

    A pattern with shortest gaps finds each character at its earliest place, so the JVM's regex does the scan."""
    window = F.regexp_extract(text, "(?s)" + ".*?".join(map(re.escape, typed)), 0)
    return F.when(F.length(window) > 0, F.lit(float(len(typed))) / F.length(window))


def key_of(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def past_questions(history: DataFrame, pins: DataFrame, typed: str, now_ms: int, n: int = QUESTIONS) -> DataFrame:
    """(text, source, score): the n best of history (text, ts in ms, count) and pins (text) for what is typed.

    Scores have six digits, so that ties are ties. Equal keys merge by partial sums: counts add up, the newest spelling is shown, a pinned one says so. Nothing typed
    gives no rows; blank and null texts are left out."""
    typed = re.sub(r"\s+", " ", typed.strip()).lower()
    asked = history.select(F.trim("text").alias("text"), F.coalesce("ts", F.lit(0)).cast("long").alias("ts"), F.greatest(F.lit(1), F.floor(F.coalesce("count", F.lit(1)))).cast("long").alias("count"), F.lit(False).alias("pinned"))
    held = pins.select(F.trim("text").alias("text"), F.lit(-1).cast("long").alias("ts"), F.lit(0).cast("long").alias("count"), F.lit(True).alias("pinned"))
    rows = asked.unionAll(held).where("text != ''").withColumn("key", key_of(F.col("text")))
    rows = rows.where(tightness(typed, F.col("key")).isNotNull()) if typed else rows.limit(0)
    merged = rows.groupBy("key").agg(F.max(F.struct("ts", "text")).alias("newest"), F.sum("count").alias("count"), F.max("pinned").alias("pinned"))
    begins = F.col("key").startswith(typed)
    recent = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now_ms) - F.col("newest.ts")) / HALF_LIFE_MS)
    often = F.least(F.lit(1.0), (F.col("count") - 1) / 7)
    signal = F.when(F.col("count") > 0, recent * RECENCY + often * FREQUENCY).otherwise(PINNED_ONLY)
    score = F.when(begins, PREFIX_QUESTION + QUALITY).otherwise(tightness(typed, F.col("key")) * QUALITY) + signal
    return merged.select(F.col("newest.text").alias("text"), F.when(F.col("pinned"), "pin").otherwise("history").alias("source"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "text").limit(n)


def quick_open(items: DataFrame, typed: str, n: int = ITEMS) -> DataFrame:
    """(id, name, path, score): the n best of items (id, name, path, kind); folders are never found.

    A name that begins with what is typed is before one that has it within, and that before a path that has it."""
    typed = typed.strip().lower()
    if not typed:
        return items.limit(0).select("id", "name", "path", F.lit(0.0).alias("score"))
    name = F.lower("name")
    tier = F.when(name.startswith(typed), PREFIX_NAME).otherwise(WITHIN_NAME)
    score = F.coalesce(tier + tightness(typed, name) * QUALITY, tightness(typed, F.lower("path")) * QUALITY)
    found = items.where("kind IS NULL OR kind != 'folder'").select("id", "name", "path", F.round(score, 6).alias("score")).where("score IS NOT NULL")
    return found.orderBy(F.desc("score"), F.length("path"), "path", "id").limit(n)


def stackable(rows: DataFrame, series: list[str]) -> DataFrame:
    """One row, whether the series are shares: no null or negative part, and each row sums to 100 (within 0.5) or 1 (0.01)."""
    parts = [F.col(s).cast("double") for s in series]
    if len(parts) < 2:
        return rows.sparkSession.range(1).select(F.lit(False).alias("stackable"))
    whole = sum(parts[1:], parts[0])
    sound = F.least(*[F.coalesce(p >= 0, F.lit(False)) for p in parts])
    sums = rows.agg(F.count("*").alias("n"), F.bool_and(sound).alias("sound"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    shares = ((F.col("lo") >= 99.5) & (F.col("hi") <= 100.5)) | ((F.col("lo") >= 0.99) & (F.col("hi") <= 1.01))
    return sums.select(F.coalesce((F.col("n") > 0) & F.col("sound") & shares, F.lit(False)).alias("stackable"))
