"""A statement run anew over exactly the files that it read, with what its answer must say of its own basis."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veritab.operators.charts import Chart, auto_chart
from veritab.plans.cards import freshness, row_cap_notes
from veritab.plans.execute import ROWS, SAVED_ROWS, SECONDS, Result, run_query, save_csv, to_markdown
from veritab.plans.guard import guard
from veritab.plans.qualify import rewritten
from veritab.sources.files import Registered, register, saved_at


@dataclass
class Direct:
    """A result, its table in Markdown, its chart where it has one, and the lines that stand under it."""

    result: Result
    markdown: str
    chart: Chart | None
    footer: list[str]
    tables: list[Registered]
    path: str | None = None


def footer(spark: SparkSession, sql: str, tables: list[Registered], skipped: int, result: Result, now: float) -> list[str]:
    """How fresh the files read are, what is not shown, which tables were cut when they were read, which files were left out."""
    times = {t.table: [s for f in t.files if (s := saved_at(f)) is not None] for t in tables}
    capped = {t.table: t.capped for t in tables if t.capped}
    out = [freshness(spark, sql, times, now), result.note, *row_cap_notes(capped)]
    if skipped:
        out.append(f"{skipped} of the files could not be read any more and were left out.")
    return [line for line in out if line]


def tables_of(spark: SparkSession, files: list[str], allowed: Callable[[str], bool] = lambda _: True) -> tuple[list[Registered], int]:
    """The views over exactly these files, families and single ones alike, and how many of the files none of them covers."""
    asked = list(dict.fromkeys(files))
    registered = register(spark, [f for f in asked if allowed(f)], slots=len(asked), most=len(asked))
    covered = {f for t in registered for f in t.files}
    return registered, sum(f not in covered for f in asked)


def run_direct(spark: SparkSession, sql: str, files: list[str], allowed: Callable[[str], bool] = lambda _: True, rows: int = ROWS, seconds: float = SECONDS) -> Direct:
    """Runs a statement over the files of an earlier answer, and nothing else. Files that are gone, unreadable or no longer
    allowed are left out, and the footer says how many; a statement that needs one of them is refused by the guard."""
    tables, skipped = tables_of(spark, files, allowed)
    sql = rewritten(sql)
    result = run_query(spark, sql, [t.table for t in tables], rows, seconds)
    return Direct(result, to_markdown(result), auto_chart(spark.sql(sql)), footer(spark, sql, tables, skipped, result, time.time()), tables)


def direct_rows(spark: SparkSession, sql: str, files: list[str]) -> DataFrame:
    """All rows of such a run."""
    tables, _ = tables_of(spark, files)
    sql = rewritten(sql)
    guard(spark, sql, [t.table for t in tables])
    return spark.sql(sql)


def save_direct(spark: SparkSession, sql: str, files: list[str], folder: str, name: str, rows: int = SAVED_ROWS) -> Direct:
    """Runs it anew twice: as it is shown, and in full up to `rows` rows into a CSV file of a name that is not taken."""
    shown = run_direct(spark, sql, files)
    shown.path = save_csv(spark.sql(rewritten(sql)), folder, name, rows)
    if shown.result.total is not None and shown.result.total > rows:
        shown.footer.append(f"The file has the first {rows:,} of {shown.result.total:,} rows.")
    return shown
