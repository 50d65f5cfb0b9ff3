"""Chart specifications of results: what kind of chart fits, its rows, stat tiles and axis helpers.

A decision is one aggregate over the result, so that it holds for results of any size; only the rows of the chart itself,
24 at most for bars, are ever shown."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.text import id_like, looks_temporal
from veritab.operators.rules import inventory, top_and_other

#: Columns and rows of a chart.
LEAST_COLUMNS, MOST_COLUMNS, LEAST_ROWS, MOST_ROWS = 2, 4, 2, 24
KINDS = ("bar", "line", "area", "band", "none")


@dataclass
class Chart:
    """kind, the label column, the series, and the rows (label string, series double) in the chart's order."""

    kind: str
    label: str
    series: list[str]
    rows: DataFrame = field(repr=False)
    bucketed: bool = False


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def chart_rows(df: DataFrame, label: str, series: list[str]) -> DataFrame:
    return df.select(F.col(label).cast("string").alias("label"), *[finite(s).alias(s) for s in series])


def auto_chart(df: DataFrame) -> Chart | None:
    """The chart that fits a result by itself, or None.

    A result of two to four columns, all but the first numeric, with two rows and more, is an area (one series) or lines over
    labels that are all temporal, a scatter for two columns of numbers whose first has fractions, and else bars. Labels that
    are identifiers by name or blank, and series with fewer than two finite numbers, have no chart. More than 24 bars of one
    series become the 23 largest and Other; more of several series have none."""
    label, *series = df.columns
    if not LEAST_COLUMNS <= len(df.columns) <= MOST_COLUMNS or not all(_numeric(df, s) for s in series) or id_like(label):
        return None
    text = F.col(label).cast("string")
    fractions = F.bool_or(F.col(label) != F.floor(label)) if isinstance(df.schema[label].dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.lit(False)
    told = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("blank"), F.bool_and(looks_temporal(text)).alias("temporal"), F.coalesce(fractions, F.lit(False)).alias("fractions"), *[F.count(finite(s)).alias(f"n_{k}") for k, s in enumerate(series)]).first()
    if told is None or told["n"] < LEAST_ROWS or told["blank"] or any(told[f"n_{k}"] < 2 for k in range(len(series))):
        return None
    if told["temporal"]:
        return Chart("area" if len(series) == 1 else "line", label, series, chart_rows(df, label, series))
    if len(series) == 1 and told["fractions"]:
        return Chart("scatter", label, series, chart_rows(df, label, series))
    if told["n"] <= MOST_ROWS:
        return Chart("bar", label, series, chart_rows(df, label, series))
    if len(series) > 1:
        return None
    return Chart("bar", label, series, top_and_other(df, label, series[0], MOST_ROWS - 1).withColumnRenamed("value", series[0]), True)


def directed_chart(df: DataFrame, kind: str, label: str, series: list[str], sort: str | None = None) -> Chart | None:
    """The chart that was asked for: None for the kind none, for unknown columns or kinds, series that are no numbers, a band
    without a value and its two bounds, and more than 24 rows. sort: asc or desc by the first series, else as it comes."""
    named = [label, *series]
    if kind not in KINDS or kind == "none" or not series or not set(named) <= set(df.columns) or not all(_numeric(df, s) for s in series):
        return None
    if kind == "band" and len(series) != 3:
        return None
    rows = chart_rows(df, label, series)
    if sort in ("asc", "desc"):
        rows = rows.orderBy(F.asc_nulls_last(series[0]) if sort == "asc" else F.desc_nulls_last(series[0]), "label")
    return None if len(rows.head(MOST_ROWS + 1)) > MOST_ROWS else Chart(kind, label, series, rows)


#: Characters of a chart's title.
TITLE = 80
DIRECTIVE = re.compile(r"```chart-request[^\S\n]*\n(.*?)```", re.S)


@dataclass
class Directive:
    """What an answer asks to be charted. Nothing but names, a sort and a title is read of it, so it brings no figures along."""

    kind: str
    label: str = ""
    series: tuple[str, ...] = ()
    lower: str | None = None
    upper: str | None = None
    title: str | None = None
    sort: str | None = None


def parse_directive(text: str) -> Directive | None:
    """The first fenced chart request of an answer; None where there is none or anything in it is not as it must be."""
    if not (found := DIRECTIVE.search(text)):
        return None
    try:
        body = json.loads(found[1])
    except ValueError:
        return None
    if not isinstance(body, dict) or body.get("kind") not in KINDS:
        return None
    if body["kind"] == "none":
        return Directive("none")
    series = body.get("series_columns")
    texts = [body.get("label_column"), *(series if isinstance(series, list) else [None]), *[body[k] for k in ("lower_column", "upper_column", "title", "sort") if k in body]]
    if not all(isinstance(t, str) for t in texts) or body.get("sort", "asc") not in ("asc", "desc"):
        return None
    title = "".join(c for c in body.get("title", "") if c.isprintable()).strip()[:TITLE]
    return Directive(body["kind"], body["label_column"], tuple(series), body.get("lower_column"), body.get("upper_column"), title or None, body.get("sort"))


def fault_of(d: Directive, df: DataFrame) -> str | None:
    """Why a directive doesn't fit a result; None if it does."""
    if d.kind == "none":
        return None
    if d.label not in df.columns:
        return f"unknown label column {d.label}"
    if not 1 <= len(d.series) <= MOST_COLUMNS - 1:
        return f"1 to {MOST_COLUMNS - 1} series columns are needed"
    if d.kind == "band" and (len(d.series) != 1 or not d.lower or not d.upper):
        return "a band has one series column and two bounds"
    for c in [*d.series, *([d.lower, d.upper] if d.kind == "band" else [])]:
        if c not in df.columns:
            return f"unknown column {c}"
        if not _numeric(df, c):
            return f"{c} is not numeric"
    return None


def decided_chart(answer: str, df: DataFrame) -> Chart | None:
    """The chart that an answer asks for if that fits, none if it asks for none, else what fits the result by itself."""
    d = parse_directive(answer)
    if d is None or fault_of(d, df):
        return auto_chart(df)
    if d.kind == "none":
        return None
    series = [*d.series, *([d.lower, d.upper] if d.kind == "band" else [])]
    return directed_chart(df, d.kind, d.label, series, d.sort)


def without_directive(answer: str) -> str:
    """An answer as it is shown, without its chart requests."""
    return re.sub(r"\n{3,}", "\n\n", DIRECTIVE.sub("", answer)).strip()


def recipe_chart(recipe: str, result: DataFrame) -> Chart | None:
    """A recipe's own chart: the band of a forecast, and of other recipes what fits their result."""
    if recipe == "forecast":
        return Chart("band", "period", ["value", "lower", "upper"], chart_rows(result.orderBy("period"), "period", ["value", "lower", "upper"]))
    return auto_chart(result)


def inventory_chart(files: DataFrame, kind: str) -> Chart:
    return Chart("bar", "kind", ["files"], chart_rows(inventory(files, kind).orderBy(F.desc("files"), "kind"), "kind", ["files"]))


def profile_chart(aggregates: dict[str, DataFrame]) -> Chart | None:
    """The chart of the aggregate with most rows among those that have one."""
    charts = [c for df in aggregates.values() if (c := auto_chart(df)) is not None]
    return max(charts, key=lambda c: c.rows.count(), default=None)


def stat_tile(df: DataFrame) -> tuple[str, float] | None:
    """(label, number) of a result of one row that is a number, or a label and a number."""
    rows = df.head(2)
    if len(rows) != 1 or not 1 <= len(df.columns) <= 2 or not _numeric(df, df.columns[-1]) or rows[0][-1] is None:
        return None
    if len(df.columns) == 2 and _numeric(df, df.columns[0]):
        return None
    return (df.columns[0] if len(df.columns) == 1 else str(rows[0][0])), float(rows[0][-1])


def stat_delta(before: float | None, after: float | None) -> tuple[float, float | None] | None:
    """(difference, per cent of the former) of two values of a tile."""
    if before is None or after is None:
        return None
    return after - before, None if before == 0 else 100 * (after - before) / abs(before)


def refinements(df: DataFrame) -> DataFrame:
    """One row (top_ten, monthly, percent): which refinements make sense. Ten best need more than ten rows, months six tenths
    of temporal labels, shares two rows."""
    label = F.col(df.columns[0]).cast("string")
    told = df.agg(F.count("*").alias("n"), F.count_if(looks_temporal(label)).alias("t"))
    return told.select((F.col("n") > 10).alias("top_ten"), ((F.col("n") > 0) & (F.col("t") >= 0.6 * F.col("n"))).alias("monthly"), (F.col("n") >= 2).alias("percent"))


def grain(df: DataFrame, label: str) -> DataFrame:
    """One row (grain): year, month, day or none, by the labels' own shapes."""
    text = F.col(label).cast("string")
    shapes = (("year", r"^\d{4}$"), ("month", r"^\d{4}-\d{2}$"), ("day", r"^\d{4}-\d{2}-\d{2}"))
    told = df.agg(*[F.coalesce(F.bool_and(text.rlike(p)), F.lit(False)).alias(k) for k, p in shapes])
    return told.select(F.coalesce(*[F.when(F.col(k), k) for k, _ in shapes], F.lit("none")).alias("grain"))


def nice_ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round numbers from below low to above high, some `about` of them, at steps of 1, 2 or 5 times a power of ten."""
    if not (math.isfinite(low) and math.isfinite(high)) or high <= low:
        return [low]
    rough = (high - low) / max(1, about)
    power = 10.0 ** math.floor(math.log10(rough))
    step = power * next(m for m in (1, 2, 5, 10) if rough <= m * power * (1 + 1e-9))
    first, last = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(k * step, 10) for k in range(first, last + 1)]


def sound(df: DataFrame, series: list[str]) -> Column:
    """Whether all series of a row are finite."""
    return reduce(and_, [finite(s).isNotNull() for s in series])
