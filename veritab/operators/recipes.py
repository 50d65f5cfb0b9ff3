"""The seven analysis recipes as DataFrame functions.

Each takes a table and the names of its date, numeric and text columns. Rows are first summed to months, a partial
aggregate, so that the windows behind it see one row a month and group, never the table's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.sources.store import new_folder, written

FORECAST_MONTHS = 3
MOVERS = 20
ACCURACY = 100_000


def kinds(df: DataFrame) -> dict[str, str]:
    """date, numeric or text of each column, by its Spark type."""
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return {f.name: "date" if isinstance(f.dataType, dates) else "numeric" if isinstance(f.dataType, T.NumericType) else "text" for f in df.schema}


def first_of(df: DataFrame, kind: str) -> str | None:
    return next((c for c, k in kinds(df).items() if k == kind), None)


def month(date: str) -> Column:
    return F.date_format(F.col(date), "yyyy-MM")


def monthly(df: DataFrame, date: str, metric: str, *groups: str) -> DataFrame:
    """(period, groups..., total): sums of the metric by month, rows without a date left out."""
    out = df.where(F.col(date).isNotNull()).groupBy(month(date).alias("period"), *groups)
    return out.agg(F.sum(F.col(metric).cast("double")).alias("total"))


def variance_vs_last_period(df: DataFrame, date: str, metric: str) -> DataFrame:
    return variance_of(monthly(df, date, metric))


def variance_of(months: DataFrame) -> DataFrame:
    """The recipe from monthly sums (period, total); so for the others below that end on `_of`."""
    ranked = months.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("period"))))
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    out = ranked.where("rn <= 2").agg(at(1, "period").alias("current_period"), at(1, "total").alias("current_total"), at(2, "period").alias("previous_period"), at(2, "total").alias("previous_total"))
    change = F.col("current_total") - F.col("previous_total")
    return out.withColumns({"delta": F.round(change, 2), "pct_change": F.round(F.try_divide(100 * change, F.nullif(F.col("previous_total"), F.lit(0.0))), 1), "current_total": F.round("current_total", 2), "previous_total": F.round("previous_total", 2)})


def cohort_breakdown(df: DataFrame, group: str, metric: str) -> DataFrame:
    return cohorts_of(df.groupBy(F.col(group).alias("cohort")).agg(F.sum(F.col(metric).cast("double")).alias("total"), F.count("*").alias("size")))


def cohorts_of(sums: DataFrame) -> DataFrame:
    share = F.try_divide(100 * F.col("total"), F.nullif(F.sum("total").over(Window.partitionBy()), F.lit(0.0)))
    return sums.select("cohort", F.round("total", 2).alias("total"), F.round(share, 1).alias("share_pct"), "size")


def completeness(df: DataFrame, error: float | None = None) -> DataFrame:
    """Rows, nulls, distinct and duplicate values of each column, in one pass over the table.

    Distinct values are exact, which sends each column's values through a shuffle; with an error (0.01, say) they are told by
    sketches of that relative deviation, and only the sketches travel."""
    distinct = F.count_distinct if error is None else lambda c: F.approx_count_distinct(c, error)
    parts = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("total_rows"), F.count_if(F.col(c).isNull()).alias("nulls"), distinct(F.col(c)).alias("distinct_values")) for c in df.columns]
    each = df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    pct = F.round(F.try_divide(100.0 * F.col("nulls"), F.nullif(F.col("total_rows"), F.lit(0)).cast("double")).cast("double"), 1)
    return each.select("column_name", "total_rows", "nulls", pct.alias("null_pct"), "distinct_values", (F.col("total_rows") - F.col("nulls") - F.col("distinct_values")).alias("duplicates"))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles of each numeric column and the rows outside 1.5 interquartile ranges.

    Quartiles are approximate: their rank is off by one in `ACCURACY` at most, and exact up to so many different values, so
    the sketch of a column is bounded whatever its size."""
    bounds = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], ACCURACY).alias(c) for c in columns]).first()
    if bounds is None:
        raise ValueError("no columns")
    out = []
    for c in columns:
        q1, q3 = bounds[c] or (None, None)
        iqr = None if q1 is None else q3 - q1
        outside = F.lit(0).cast("long") if iqr is None else F.count_if((F.col(c) < q1 - 1.5 * iqr) | (F.col(c) > q3 + 1.5 * iqr))
        out.append(F.struct(F.lit(c).alias("column_name"), *[F.round(F.lit(v).cast("double"), 4).alias(k) for k, v in (("q1", q1), ("q3", q3), ("iqr", iqr))], outside.alias("outliers")))
    return df.agg(F.array(*out).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def scored_months(df: DataFrame, date: str, metric: str) -> DataFrame:
    """(period, total, z): how many sample deviations each month is from the mean month."""
    return scored_of(monthly(df, date, metric))


def scored_of(months: DataFrame) -> DataFrame:
    every = Window.partitionBy()
    months = months.withColumns({"mean": F.avg("total").over(every), "sd": F.stddev_samp("total").over(every)})
    return months.select("period", F.round("total", 2).alias("total"), F.round(F.try_divide(F.col("total") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))), 2).alias("z"))


def anomaly_scan(df: DataFrame, date: str, metric: str, limit: float = 2.0) -> DataFrame:
    return anomalies_of(monthly(df, date, metric), limit)


def anomalies_of(months: DataFrame, limit: float = 2.0) -> DataFrame:
    return scored_of(months).where(F.abs("z") > limit).orderBy(F.desc(F.abs("z")), "period")


def top_movers(df: DataFrame, group: str, metric: str, date: str | None = None, n: int = MOVERS) -> DataFrame:
    """The groups that changed most between their latest two months; without a date the largest totals."""
    if date is None:
        sums = df.groupBy(F.col(group).alias("cohort")).agg(F.round(F.sum(F.col(metric).cast("double")), 2).alias("total"))
        return sums.orderBy(F.desc(F.abs("total")), "cohort").limit(n)
    return movers_of(monthly(df, date, metric, group).withColumnRenamed(group, "cohort"), n)


def movers_of(sums: DataFrame, n: int = MOVERS) -> DataFrame:
    """sums: (period, cohort, total)."""
    sums = sums.withColumn("rn", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("period"))))
    two = sums.where("rn <= 2").groupBy("cohort").agg(*[F.max(F.when(F.col("rn") == k, F.col("total"))).alias(x) for k, x in ((1, "current_total"), (2, "previous_total"))])
    change = F.col("current_total") - F.col("previous_total")
    out = two.select("cohort", F.round("current_total", 2).alias("current_total"), F.round("previous_total", 2).alias("previous_total"), F.round(change, 2).alias("change"), F.round(F.try_divide(100 * change, F.nullif(F.col("previous_total"), F.lit(0.0))), 1).alias("pct_change"))
    return out.where("change IS NOT NULL").orderBy(F.desc(F.abs("change")), "cohort").limit(n)


def fitted(months: DataFrame) -> DataFrame:
    """Monthly sums with their numbers i from 0, the calendar's own count so that labels can go on, and the least-squares line
    over them: slope, intercept, sigma (n - 2 degrees of freedom), n. All are windows over one row a month."""
    every = Window.partitionBy()
    numbered = months.withColumn("i", (F.row_number().over(Window.orderBy("period")) - 1).cast("double"))
    fit = {c: f("total", "i").over(every) for c, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("syy", F.regr_syy), ("sxy", F.regr_sxy))}
    known = numbered.withColumns(fit | {"n": F.count("*").over(every)})
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return known.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2)))).drop("syy", "sxy")


def forecast_fit(df: DataFrame, date: str, metric: str) -> DataFrame:
    """slope, intercept, sigma and n of the least-squares line over the month's number."""
    fit = fitted(monthly(df, date, metric)).where(F.col("i") == 0).select("slope", "intercept", "sigma", "n")
    return fit


def forecast(df: DataFrame, date: str, metric: str, ahead: int = FORECAST_MONTHS) -> DataFrame:
    """History (kind actual) and, from three months on, `ahead` further months with a 95 % band."""
    return forecast_of(monthly(df, date, metric), ahead)


def forecast_of(months: DataFrame, ahead: int = FORECAST_MONTHS) -> DataFrame:
    """Each month gives its own row, and the last one the rows to come as well, so the sums are read once."""
    own = F.struct(F.col("period"), F.round("total", 2).alias("value"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.lit("actual").alias("kind"))

    def coming(k: Column) -> Column:
        value, band = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + k), 1.96 * F.col("sigma")
        period = F.date_format(F.add_months(F.to_date(F.concat("period", F.lit("-01"))), k), "yyyy-MM")
        return F.struct(period.alias("period"), F.round(value, 2).alias("value"), F.round(value - band, 2).alias("lower"), F.round(value + band, 2).alias("upper"), F.lit("forecast").alias("kind"))

    last = (F.col("i") == F.col("n") - 1) & (F.col("n") >= 3)
    rows = F.when(last, F.concat(F.array(own), F.transform(F.sequence(F.lit(1), F.lit(ahead)), coming))).otherwise(F.array(own))
    return fitted(months).select(F.explode(rows).alias("r")).select("r.*")


def changepoint_scan(df: DataFrame, date: str, metric: str) -> DataFrame:
    """The split of the months with the largest change of mean, by deviation; needs four months."""
    return changepoint_of(monthly(df, date, metric))


def changepoint_of(months: DataFrame) -> DataFrame:
    every = Window.partitionBy()
    so_far = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    months = months.withColumns({"n": F.count("*").over(every), "sum": F.sum("total").over(every), "sd": F.stddev_samp("total").over(every), "k": F.count("*").over(so_far), "part": F.sum("total").over(so_far)})
    before, after = F.col("part") / F.col("k"), (F.col("sum") - F.col("part")) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    split = months.where("n >= 4 AND k < n").select("period", before.alias("b"), after.alias("a"), F.coalesce("sd", F.lit(0.0)).alias("sd"))
    scored = split.select("period", F.round("b", 2).alias("mean_before"), F.round("a", 2).alias("mean_after"), F.round(F.col("a") - F.col("b"), 2).alias("delta"), F.round(F.abs(F.col("a") - F.col("b")) / (F.col("sd") + 1e-9), 2).alias("magnitude"))
    return scored.orderBy(F.desc("magnitude"), "period").limit(1)


#: Columns beyond which distinct values are told by sketches unless the caller says otherwise, and the sketches' error.
EXACT_COLUMNS, SKETCH_ERROR = 16, 0.01


def data_quality(df: DataFrame, most: int = 4, error: float | None = None) -> DataFrame:
    """The completeness of each column with the quartiles and outliers of the first `most` numeric ones, null for others.

    error: of the distinct counts; by default they are exact for tables of up to `EXACT_COLUMNS` columns."""
    numeric = [c for c, k in kinds(df).items() if k == "numeric"][:most]
    whole = completeness(df, SKETCH_ERROR if error is None and len(df.columns) > EXACT_COLUMNS else error or None)
    if not numeric:
        return whole.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("q1", "double"), ("q3", "double"), ("iqr", "double"), ("outliers", "long"))])
    return whole.join(iqr_outliers(df, numeric), "column_name", "left")


#: Recipe id: (kinds of columns it needs, function of a table and those columns).
RECIPES = {
    "variance-vs-last-period": (("date", "numeric"), variance_vs_last_period),
    "cohort-breakdown": (("text", "numeric"), cohort_breakdown),
    "data-quality-audit": ((), data_quality),
    "anomaly-scan": (("date", "numeric"), anomaly_scan),
    "top-movers": (("text", "numeric", "date"), top_movers),
    "forecast": (("date", "numeric"), forecast),
    "changepoint-scan": (("date", "numeric"), changepoint_scan),
}


def run_recipe(df: DataFrame, recipe: str) -> DataFrame | None:
    """The recipe over the table's first column of each kind; None where a kind is missing."""
    needs, function = RECIPES[recipe]
    chosen = [first_of(df, k) for k in needs]
    return None if None in chosen else function(df, *chosen)


def applicable(df: DataFrame) -> list[str]:
    return [r for r, (needs, _) in RECIPES.items() if all(first_of(df, k) for k in needs)]


#: Pairs of recipe and table that a map of what can be asked has at most.
CARDS = 24


def capabilities(tables: dict[str, DataFrame], most: int = CARDS) -> tuple[list[tuple[str, str]], list[str], int]:
    """(recipe and table of what can be run, tables that a report can be made of, how many pairs were left out).

    Tables come in their given order and recipes in theirs; a report needs a date and a number."""
    pairs = [(r, name) for name, df in tables.items() for r in applicable(df)]
    reports = [name for name, df in tables.items() if first_of(df, "date") and first_of(df, "numeric")]
    return pairs[:most], reports, max(0, len(pairs) - most)


#: Tables that are looked at for findings.
TABLES = 12


def insights(tables: dict[str, DataFrame], most: int = 8, looked_at: int = TABLES) -> DataFrame:
    """Anomalies, movers of 25 % and more, and changepoints of magnitude 1 and more over tables with a date and a number; no
    rows where no table has both. Tables beyond the first `looked_at` are left out; `left_out` names them.

    Each table is read once, for its sums by month and group, from which all three follow."""
    found = []
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    for name, df in list(tables.items())[:looked_at]:
        date, metric, group = (first_of(df, k) for k in ("date", "numeric", "text"))
        if not date or not metric:
            continue
        cohort = F.col(group).cast("string") if group else F.lit(None).cast("string")
        sums = written(monthly(df.withColumn("_cohort", cohort), date, metric, "_cohort").withColumnRenamed("_cohort", "cohort"), new_folder(spark, "months"))
        months = months_of(sums)
        row = lambda kind, label, size: [F.lit(name).alias("table_name"), F.lit(kind).alias("kind"), label.alias("label"), size.alias("magnitude")]  # noqa: B023, E731
        found.append(anomalies_of(months).select(*row("anomaly", F.col("period"), F.abs("z"))))
        found.append(changepoint_of(months).where("magnitude >= 1").select(*row("changepoint", F.col("period"), F.col("magnitude"))))
        if group:
            found.append(movers_of(sums).where("abs(pct_change) >= 25").select(*row("mover", F.col("cohort"), F.abs("pct_change") / 100)))
    if not found:
        return spark.createDataFrame([], "table_name string, kind string, label string, magnitude double")
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("magnitude"), "table_name", "kind", "label").limit(most)


def left_out(tables: dict[str, DataFrame], looked_at: int = TABLES) -> list[str]:
    """The tables that `insights` does not look at."""
    return list(tables)[looked_at:]


def months_of(sums: DataFrame) -> DataFrame:
    """(period, total) of sums by month and group."""
    return sums.groupBy("period").agg(F.sum("total").alias("total"))
