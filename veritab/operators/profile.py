"""Table profiles: what each column holds, yearly sums and sums by a small text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.recipes import kinds


def profile_columns(df: DataFrame) -> DataFrame:
    """(column_name, kind, n, sum, mean, least, most, distinct_values) of each column, in one pass."""
    none = F.lit(None).cast("double")
    parts = []
    for c, kind in kinds(df).items():
        value = F.col(c).cast("double") if kind == "numeric" else F.year(c).cast("double") if kind == "date" else None
        numbers = [none] * 4 if value is None else [none, none, F.min(value), F.max(value)] if kind == "date" else [F.sum(value), F.avg(value), F.min(value), F.max(value)]
        named = [F.round(v, 2).alias(k) for v, k in zip(numbers, ("sum", "mean", "least", "most"), strict=True)]
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.count(c).alias("n"), *named, (F.count_distinct(c) if kind == "text" else F.lit(None).cast("long")).alias("distinct_values")))
    return df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def year_sums(df: DataFrame, date: str, metrics: list[str]) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(*[F.round(F.sum(F.col(m).cast("double")), 2).alias(m) for m in metrics])


def group_sums(df: DataFrame, group: str, metrics: list[str], least: int = 2, most: int = 8) -> DataFrame:
    """Sums by a text column that has `least` to `most` values; empty otherwise. The grouped rows are few, so the count
    behind the window is of groups."""
    sums = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("label")).agg(*[F.round(F.sum(F.col(m).cast("double")), 2).alias(m) for m in metrics])
    values = df.agg(F.count_distinct(group).alias("n"))
    return sums.where(values.select("n").scalar().between(least, most))


#: Numeric columns that are summed by year and group, years and groups that are shown, characters of a profile.
SUMMED, YEARS, GROUPS, CHARS = 2, (2, 6), (2, 8), 1200


def plain_number(value: float | None) -> str:
    """Two digits at most, without closing zeros."""
    text = f"{round(value or 0.0, 2):.2f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def profile_text(name: str, df: DataFrame, chars: int = CHARS) -> str:
    """A table's profile as text: its rows, what each column holds, sums by year of each date column and by each text column of
    few values. Two readings of the table: one for the columns, one by grouping sets for all sums. A longer text is cut, and
    says so by its last character."""
    columns = profile_columns(df).collect()
    rows = df.count() if not columns else None
    numeric = [c["column_name"] for c in columns if c["kind"] == "numeric"][:SUMMED]
    dates = [c["column_name"] for c in columns if c["kind"] == "date"]
    texts = [c["column_name"] for c in columns if c["kind"] == "text" and GROUPS[0] <= c["distinct_values"] <= GROUPS[1]]
    keys = [*[F.year(F.col(f"`{c}`")).cast("string") for c in dates], *[F.col(f"`{c}`").cast("string") for c in texts]]
    plain = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(numeric)])
    sets = [[], *[[F.col(f"k{i}")] for i in range(len(keys))]]
    sums = [x for i in range(len(numeric)) for x in (F.sum(f"v{i}").alias(f"s{i}"), F.count(f"v{i}").alias(f"n{i}"))]
    which = F.coalesce(*[F.when(F.grouping(f"k{i}") == 0, F.lit(i)) for i in range(len(keys))], F.lit(-1)).alias("which") if keys else F.lit(-1).alias("which")
    key = F.coalesce(*[F.col(f"k{i}") for i in range(len(keys))], F.lit(None).cast("string")).alias("key")
    grouped = plain.groupingSets(sets, *[F.col(f"k{i}") for i in range(len(keys))]) if keys else plain.groupBy()
    found = grouped.agg(which, key, F.count("*").alias("rows"), *sums).collect()
    rows = next((r["rows"] for r in found if r["which"] == -1), 0) if rows is None else rows

    def told(c) -> str:
        if c["kind"] == "numeric":
            return f"{c['column_name']} (number: sum {plain_number(c['sum'])}, mean {plain_number(c['mean'])}, min {plain_number(c['least'])}, max {plain_number(c['most'])})"
        if c["kind"] == "date":
            return f"{c['column_name']} (date: years {int(c['least'] or 0)}–{int(c['most'] or 0)})"
        return f"{c['column_name']} (text: {c['distinct_values']} distinct)"

    lines = [f"Profile of {name}, computed from all of it", f"rows: {rows}", f"columns: {'; '.join(map(told, columns))}"]
    for i, k in enumerate([*dates, *texts]):
        least, most = YEARS if i < len(dates) else GROUPS
        for j, v in enumerate(numeric):
            by = sorted((r["key"], r[f"s{j}"]) for r in found if r["which"] == i and r["key"] not in (None, "") and r[f"n{j}"])
            if least <= len(by) <= most:
                of = f"year({k})" if i < len(dates) else k
                lines.append(f"sum of {v} by {of}: {' · '.join(f'{x}: {plain_number(s)}' for x, s in by)}")
    text = "\n".join(lines)
    return text if len(text) <= chars else text[: chars - 1] + "…"
