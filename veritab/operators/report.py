"""A deep-analysis report of one table: all recipes from one reading of it.

The table is grouped once, by grouping sets: by month and group, and by the values of each column. What comes of it, a row for
each month and group and one for each different value, is written to the shared folder, and every recipe and finding is
computed from that. Each number of the report is a cell of those results; a second run gives the same bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.operators import recipes
from veritab.plans.execute import Result, to_markdown
from veritab.sources.store import new_folder, written

#: Rows that a section shows, and numeric columns with quartiles.
SHOWN, QUARTILES = 20, 4
PARTIAL_MONTH = "Figures over time are sums by calendar month; the latest month may be incomplete."


@dataclass
class Section:
    recipe: str
    rows: list[tuple]
    columns: list[str]
    headline: str | None
    total: int


@dataclass
class Report:
    table: str
    sections: list[Section] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)

    @property
    def summary(self) -> list[str]:
        return [s.headline for s in self.sections if s.headline and s.recipe != "data-quality-audit"]


class Facts:
    """What one reading of a table tells: sums by month and group, and the counts of each column's values."""

    def __init__(self, df: DataFrame, date: str, metric: str, group: str | None):
        self.columns, self.spark = df.columns, df.sparkSession
        self.numeric = [c for c, k in recipes.kinds(df).items() if k == "numeric"][:QUARTILES]
        value = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]
        cohort = F.col(f"`{group}`").cast("string") if group else F.lit(None).cast("string")
        plain = df.select(recipes.month(date).alias("period"), cohort.alias("cohort"), F.col(f"`{metric}`").cast("double").alias("metric"), *value)
        names = [f"c{k}" for k in range(len(df.columns))]
        sets = [[F.col("period"), F.col("cohort")], *[[F.col(c)] for c in names]]
        grouped = plain.groupingSets(sets, F.col("period"), F.col("cohort"), *map(F.col, names))
        # A column's own grouping tells which set a row is of; a null value is a value here.
        own = [F.when(F.grouping(c) == 0, F.lit(k)) for k, c in enumerate(names)]
        number = [F.when(F.grouping(f"c{k}") == 0, F.col(f"c{k}").cast("double")) for k, c in enumerate(df.columns) if c in self.numeric]
        told = [F.when(F.grouping(c) == 0, F.col(c).isNull()) for c in names]
        facts = grouped.agg(F.coalesce(*own, F.lit(-1)).alias("set"), F.coalesce(*told, F.lit(False)).alias("none"), (F.coalesce(*number) if number else F.lit(None).cast("double")).alias("number"), F.sum("metric").alias("total"), F.count("*").alias("n"))
        self.plan = facts.select("period", "cohort", "set", "none", "number", "total", "n")
        self.rows = written(self.plan, new_folder(self.spark, "facts"))

    def month_groups(self) -> DataFrame:
        """(period, cohort, total) of rows with a date."""
        return self.rows.where("set = -1 AND period IS NOT NULL").select("period", "cohort", "total")

    def cohorts(self) -> DataFrame:
        """(cohort, total, size), rows without a date too."""
        return self.rows.where("set = -1").groupBy("cohort").agg(F.sum("total").alias("total"), F.sum("n").alias("size"))

    def quartiles(self) -> dict[int, tuple[float, float]]:
        """The exact quartiles of each numeric column by its place. Values lie in ranges; the ranges' sizes tell in which one a
        quartile is, and only that range is counted through, so no task has a whole column."""
        spark = self.spark
        ranged = self.rows.where("number IS NOT NULL").select("set", "number", "n").repartitionByRange("set", "number")
        held = written(ranged.withColumn("part", F.spark_partition_id()), new_folder(spark, "values"))
        wanted: list[tuple[int, int, int, float]] = []
        sizes: dict[int, list[tuple[int, int]]] = {}
        for r in held.groupBy("set", "part").agg(F.sum("n").alias("n")).orderBy("set", "part").collect():
            sizes.setdefault(r["set"], []).append((r["part"], r["n"]))
        for place, parts in sizes.items():
            total = sum(n for _, n in parts)
            for k, q in enumerate((0.25, 0.75)):
                before = 0
                for part, n in parts:
                    if before + n >= q * total:
                        wanted.append((place, part, k, q * total - before))
                        break
                    before += n
        if not wanted:
            return {}
        few = spark.createDataFrame(wanted, "set int, part int, k int, rank double")
        inside = held.join(F.broadcast(few), ["set", "part"]).withColumn("upto", F.sum("n").over(Window.partitionBy("set", "part", "k").orderBy("number")))
        found: dict[int, list] = {}
        for r in inside.where("upto >= rank").groupBy("set", "k").agg(F.min("number").alias("v")).collect():
            found.setdefault(r["set"], [None, None])[r["k"]] = r["v"]
        return {place: tuple(v) for place, v in found.items()}

    def quality(self) -> DataFrame:
        """What `recipes.data_quality` gives, from the values' counts; quartiles are exact."""
        each = self.rows.where("set >= 0")
        names = {c: k for k, c in enumerate(self.columns)}
        quartiles = self.quartiles()
        bounds = [(k, *map(float, quartiles[k])) for c in self.numeric if (k := names[c]) in quartiles]
        bound = each.join(F.broadcast(self.spark.createDataFrame(bounds, "set int, _q1 double, _q3 double")), "set", "left")
        wide = 1.5 * (F.col("_q3") - F.col("_q1"))
        outside = F.when((F.col("number") < F.col("_q1") - wide) | (F.col("number") > F.col("_q3") + wide), F.col("n")).otherwise(0)
        sums = bound.groupBy("set").agg(F.sum("n").alias("total_rows"), F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("nulls"), F.count_if(~F.col("none")).alias("distinct_values"), F.max("_q1").alias("q1"), F.max("_q3").alias("q3"), F.sum(outside).alias("outliers"))
        name = F.element_at(F.array(*map(F.lit, self.columns)), F.col("set") + 1)
        numeric = name.isin(self.numeric) if self.numeric else F.lit(False)
        shown: list[Column] = [F.when(numeric, F.round(c, 4)).alias(a) for c, a in ((F.col("q1"), "q1"), (F.col("q3"), "q3"), (F.col("q3") - F.col("q1"), "iqr"))]
        pct = F.round(100.0 * F.col("nulls") / F.col("total_rows"), 1).alias("null_pct")
        return sums.select(name.alias("column_name"), "total_rows", "nulls", pct, "distinct_values", (F.col("total_rows") - F.col("nulls") - F.col("distinct_values")).alias("duplicates"), *shown, F.when(numeric, F.col("outliers")).alias("outliers"))


def sections(facts: Facts, grouped: bool) -> dict[str, DataFrame]:
    """Each recipe's rows from the facts, in the recipes' own order."""
    sums = facts.month_groups()
    months = recipes.months_of(sums)
    out = {"variance-vs-last-period": recipes.variance_of(months)}
    if grouped:
        out["cohort-breakdown"] = recipes.cohorts_of(facts.cohorts()).orderBy(F.desc_nulls_last("total"), "cohort")
    out["data-quality-audit"] = facts.quality().orderBy("column_name")
    out["anomaly-scan"] = recipes.anomalies_of(months)
    if grouped:
        out["top-movers"] = recipes.movers_of(sums)
    out["forecast"] = recipes.forecast_of(months).orderBy("period")
    out["changepoint-scan"] = recipes.changepoint_of(months)
    return out


def headline(recipe: str, columns: list[str], rows: list[tuple]) -> str | None:
    """One sentence of a section's first row; None where it has none that tells something."""
    if not rows:
        return None
    first = dict(zip(columns, rows[0], strict=True))
    if recipe == "variance-vs-last-period" and first["delta"] is not None:
        pct = "" if first["pct_change"] is None else f" ({first['pct_change']:+.1f} %)"
        return f"{first['current_period']}: {first['delta']:+,.2f} against {first['previous_period']}{pct}."
    if recipe == "cohort-breakdown" and first["share_pct"] is not None:
        return f"{first['cohort']} has the largest share, {first['share_pct']:.1f} %."
    if recipe == "anomaly-scan":
        return f"{first['period']} is {abs(first['z']):.2f} deviations from the mean month."
    if recipe == "top-movers":
        return f"{first['cohort']} changed most, by {first['change']:+,.2f}."
    if recipe == "changepoint-scan":
        return f"The level changed after {first['period']}, by {first['delta']:+,.2f}."
    if recipe == "forecast" and (coming := [dict(zip(columns, r, strict=True)) for r in rows if r[-1] == "forecast"]):
        return f"{coming[0]['period']} is expected at {coming[0]['value']:,.2f}."
    if recipe == "data-quality-audit":
        worst = max((dict(zip(columns, r, strict=True)) for r in rows), key=lambda r: r["null_pct"])
        return f"{worst['column_name']} is empty in {worst['null_pct']:.1f} % of the rows." if worst["nulls"] else None
    return None


def investigate(name: str, df: DataFrame) -> Report:
    """The report of a table's first date, number and text column; without a date or a number one without sections."""
    date, metric, group = (recipes.first_of(df, k) for k in ("date", "numeric", "text"))
    report = Report(name)
    if not date or not metric:
        return report
    for recipe, rows in sections(Facts(df, date, metric, group), group is not None).items():
        found = [tuple(r) for r in rows.head(SHOWN + 1)] if recipe not in ("forecast", "data-quality-audit") else [tuple(r) for r in rows.collect()]
        if not found:
            continue
        shown = found[-SHOWN:] if recipe == "forecast" else found[:SHOWN]
        line = headline(recipe, rows.columns, found)
        report.sections.append(Section(recipe, shown, rows.columns, line, len(found)))
        if recipe == "data-quality-audit" and line:
            report.caveats.append(line)
    report.caveats.insert(0, PARTIAL_MONTH)
    return report


TEMPLATES = {"standard": ("Summary", "Findings"), "scientific": ("Introduction", "Results"), "business": ("Bottom line", "Supporting analysis")}


def render(report: Report, template: str = "standard") -> str:
    """The report in Markdown. The scientific form names its method, the business form puts one line first."""
    top, body = TEMPLATES[template]
    summary = report.summary or ["No single figure stands out."]
    lines = [f"# Report on {report.table}", "", f"## {top}", ""]
    lines += [summary[0]] if template == "business" else [f"- {s}" for s in summary]
    if template == "scientific":
        lines += ["", "## Method", "", "The table was grouped once, by month, by group and by the values of each column; every figure is a result of that."]
    if template == "business" and len(summary) > 1:
        lines += ["", "## Key findings", "", *[f"- {s}" for s in summary]]
    lines += ["", f"## {body}", ""]
    for s in report.sections:
        lines += [f"### {s.recipe}", "", to_markdown(Result(s.columns, s.rows, s.total > len(s.rows), None)), ""]
        if s.total > len(s.rows):
            lines += [f"_{len(s.rows)} rows are shown._", ""]
    if not report.sections:
        lines += ["_no rows_", ""]
    return "\n".join([*lines, "## Caveats", "", *[f"- {c}" for c in report.caveats or ["The table has no date or no number."]]]) + "\n"


def report_rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(section, label, value): the telling number of each row of every section."""
    date, metric, group = (recipes.first_of(df, k) for k in ("date", "numeric", "text"))
    told = {"variance-vs-last-period": ("current_period", "delta"), "cohort-breakdown": ("cohort", "total"), "data-quality-audit": ("column_name", "distinct_values"), "anomaly-scan": ("period", "z"), "top-movers": ("cohort", "change"), "forecast": ("period", "value"), "changepoint-scan": ("period", "magnitude")}
    out = None
    for recipe, rows in sections(Facts(df, date, metric, group), group is not None).items():
        label, value = told[recipe]
        one = rows.select(F.lit(recipe).alias("section"), F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
