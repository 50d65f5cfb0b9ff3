"""Curation rules, listings and bucketing as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(files: DataFrame, rules: DataFrame, key: str, path: str) -> DataFrame:
    """(key, included), a row for each row of files: the verdict of the last rule of the deepest scope that fits; included
    where none does, and where the path is null.

    rules: (scope, pattern, verdict, position), verdict include, exclude or clear, which undoes the rules above it. The
    different paths meet the rules by an equi-join of their prefixes of the lengths that scopes have, and the patterns are
    tested after it; of all rules that fit a path only the strongest is kept, by a partial max."""
    lengths = [r[0] for r in rules.select(F.length("scope")).distinct().collect()]
    paths = files.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct()
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    near = paths.select("_path", F.explode(prefixes).alias("scope")).join(rules, "scope").where("_path RLIKE pattern")
    strongest = near.groupBy("_path").agg(F.max(F.struct(F.length("scope"), F.col("position"), F.col("verdict"))).alias("s"))
    verdict = strongest.select("_path", F.col("s.verdict").alias("_verdict"))
    found = files.select(key, F.col(path).alias("_path")).join(verdict, "_path", "left")
    return found.select(key, F.coalesce(F.col("_verdict") != "exclude", F.lit(True)).alias("included"))


def decide_all(files: DataFrame, rules: DataFrame, key: str, path: str, own: str, parent: str | None = None) -> DataFrame:
    """(key, included): a file in an excluded folder is excluded, whatever else holds; then its own flag decides (own, true or
    false), then the rules, then it is included. parent: a column of the excluded folder around it, null where there is none."""
    ruled = decide(files, rules, key, path)
    out = files.select(key, F.col(own).alias("_own"), (F.col(parent).isNotNull() if parent else F.lit(False)).alias("_away")).join(ruled, key)
    return out.select(key, F.when(F.col("_away"), False).otherwise(F.coalesce("_own", "included")).alias("included"))


def shareable(files: DataFrame, local_only: DataFrame, key: str, cloud: bool) -> DataFrame:
    """Included files, without those that must stay local where the answer leaves the machine."""
    kept = files.where("included")
    return kept.join(local_only.select(key).distinct(), key, "left_anti") if cloud else kept


def whats_new(files: DataFrame, saved: str, now: Column, days: int, most: int = 15) -> DataFrame:
    """Files saved within so many days, newest first."""
    return files.where((F.col(saved) <= now) & (F.col(saved) > now - F.make_interval(days=F.lit(days)))).orderBy(F.desc(saved), "name").limit(most)


def inventory(files: DataFrame, kind: str, most: int = 10) -> DataFrame:
    """Files by kind, most first; kinds beyond the first `most` are one row, other."""
    counts = files.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("files"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("files"), "kind")))
    return ranked.groupBy(F.when(F.col("rank") <= most, F.col("kind")).otherwise("other").alias("kind")).agg(F.sum("files").alias("files"))


def with_column(columns: DataFrame, wanted: str) -> DataFrame:
    """(table_name, column_name): tables that have a column of the name; where none has, those whose column names hold it."""
    named = columns.withColumn("exact", F.lower("column_name") == wanted.lower()).where(F.col("exact") | F.lower("column_name").contains(wanted.lower()))
    return named.where(F.col("exact") | ~F.coalesce(named.agg(F.bool_or("exact").alias("e")).select("e").scalar(), F.lit(False))).select("table_name", "column_name")


def top_and_other(totals: DataFrame, label: str, value: str, n: int = 23) -> DataFrame:
    """The n largest rows and the rest summed as Other. The first n are found by a top-k, the rest by a partial sum."""
    top = totals.orderBy(F.desc_nulls_last(value), label).limit(n).select(F.col(label).cast("string").alias("label"), F.round(value, 2).alias("value"))
    sums = totals.agg(F.sum(value).alias("v"), F.count("*").alias("c"))
    rest = top.agg(F.sum("value").alias("t")).select(F.lit("Other").alias("label"), F.round(sums.select("v").scalar() - F.col("t"), 2).alias("value"), sums.select("c").scalar().alias("c"))
    return top.union(rest.where(F.col("c") > n).select("label", "value"))


def evenly_spaced(rows: DataFrame, key: str, m: int) -> DataFrame:
    """m rows at even steps of key's order, first and last among them, the first alone if m is 1; needs key to count from 0 without gaps."""
    n = rows.count()
    if n <= m:
        return rows
    if m < 2:
        return rows.where(F.col(key) < m)
    return rows.where(F.col(key).isin(sorted({i * (n - 1) // (m - 1) for i in range(m)})))


def recency(days: Column) -> Column:
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "This week").otherwise("Earlier")


def recall(exchanges: DataFrame, question_terms: list[str], group: str, key: str, terms: str, least: int = 2, n: int = 3) -> DataFrame:
    """The best exchange of each conversation by shared terms, n conversations."""
    shared = F.size(F.array_intersect(F.col(terms), F.array(*map(F.lit, question_terms))))
    best = exchanges.select(group, key, shared.alias("overlap")).where(F.col("overlap") >= least).groupBy(group).agg(F.max(F.struct("overlap", -F.col(key))).alias("b"))
    return best.select(group, (-F.col("b.col2")).alias(key), F.col("b.overlap").alias("overlap")).orderBy(F.desc("overlap"), group).limit(n)


def latest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The newest row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
