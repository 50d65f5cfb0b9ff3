"""Digests of whole results, computed where the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_sums(df: DataFrame) -> DataFrame:
    """One row (rows, a, b): sums of two hashes of each row, which tell a result's rows whatever their order.

    Columns count by place, not by name. Each row travels as two numbers, and sums of partitions as three."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    # Maps have no order of their own, so they are hashed by their entries in order; a hash skips nulls, so they are counted.
    value = [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.col(c) for c, kind in plain.dtypes]
    seen = [F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in plain.columns])] if plain.columns else [F.lit("")]
    hashed = plain.select(*[F.xxhash64(F.lit(k), *seen, *value).cast("decimal(38,0)").alias(n) for k, n in ((1, "a"), (2, "b"))])
    return hashed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))


def digest_column(rows="rows", a="a", b="b"):
    """The digest of row_sums as 40 hexadecimal digits."""
    return F.sha1(F.concat_ws(" ", *(F.col(c).cast("string") for c in (rows, a, b))))


def whole_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of all rows in any order."""
    found = row_sums(df).select("rows", digest_column().alias("digest")).first()
    return found["rows"], found["digest"]
