"""Tables as they are shown: sorted by a column as a reader would, and read back from piped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.sources.store import new_folder, written

#: Signs of currencies that a number may carry.
CURRENCY = "$€£¥₩₹¢₽¤"


def blank_cell(cell: Column) -> Column:
    """No value: nothing, dashes, or null."""
    bare = F.regexp_replace(cell, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.coalesce(bare.rlike("^[-–—]*$") | (F.lower(bare) == "null"), F.lit(True))


def cell_number(cell: Column) -> Column:
    """The finite number that a cell shows under currency signs, separators and one percent sign at its end; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"[\s\p{Z}]+$", ""), "%$", ""), f"[{CURRENCY},\\s\\p{{Z}}]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def natural_text(cell: Column) -> Column:
    """A text that sorts without regard to case and accents, and by value where it has digits: each run of digits follows its
    own length without leading zeros."""
    runs = F.regexp_extract_all(cell, F.lit(r"\d+|\D+"), F.lit(0))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, part), ""), "UNICODE_CI_AI")


def sort_rows(df: DataFrame, column: str, descending: bool = False, place: str | None = None) -> DataFrame:
    """The rows by a column's cells: numbers by value before texts in natural order, cells without a value last in both
    directions, equal ones as they stood. place: the column that says how they stood; where there is none, the order in
    which they are read counts.

    The order is one key of columns, so Spark sorts by ranges and no task has all rows."""
    cell = F.col(column).cast("string")
    number = cell_number(cell)
    way = F.desc if descending else F.asc
    keyed = df.withColumn("_at", F.col(place) if place else F.monotonically_increasing_id())
    keyed = keyed.withColumns({"_blank": blank_cell(cell), "_text": number.isNull(), "_number": number, "_natural": F.when(number.isNull(), natural_text(cell))})
    return keyed.orderBy("_blank", *[way(F.when(~F.col("_blank"), F.col(c))) for c in ("_text", "_number", "_natural")], "_at").drop("_at", "_blank", "_text", "_number", "_natural")


def with_positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """A sorted frame's rows with their places from 1, by the sizes of its ranges; no task counts all rows."""
    spark = ordered.sparkSession
    at = written(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in")), new_folder(spark, "sorted"))
    sizes = sorted(tuple(r) for r in at.groupBy("_part").count().collect())
    before, offsets = 1, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    told = spark.createDataFrame(offsets, "_part int, _before long")
    return at.join(F.broadcast(told), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


# Piped text.


def piped_line(*cells: Column) -> Column:
    """A row as a line of a piped table: backslashes and pipes are escaped, line breaks are spaces."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r\n|[\r\n]", " ")

    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))


def line_cells(line: Column) -> Column:
    """The cells of a piped line, unescaped and trimmed; a line without pipes at its ends is read the same."""
    bare = F.regexp_replace(F.trim(line), r"^\|", "")
    closed = F.when(bare.rlike(r"(?<!\\)(?:\\\\)*\|$"), bare).otherwise(F.concat(bare, F.lit("|")))
    found = F.regexp_extract_all(closed, F.lit(r"((?:\\.|[^\\|]|\\$)*)\|"), F.lit(1))
    return F.transform(found, lambda c: F.regexp_replace(F.trim(c), r"\\([\\|])", "$1"))


def table_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, header, row, cells): the rows of the first piped table of each text, cut or filled to its header's width.

    A table is a line with a pipe, a line of dashes under it, and the piped lines that follow at once."""
    lines = F.transform(F.split(F.col(text), "\r?\n"), lambda x: F.trim(x))
    dashes = r"^\|?(?:\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?$"
    placed = texts.select(key, lines.alias("l")).withColumn("at", F.array_position(F.transform("l", lambda x, i: x.rlike(dashes) & (i > 0) & F.coalesce(F.get("l", i - 1).contains("|"), F.lit(False))), True))
    some = placed.where("at > 1").select(key, F.get("l", (F.col("at") - 2).cast("int")).alias("head"), F.slice("l", (F.col("at") + 1).cast("int"), F.greatest(F.size("l") - F.col("at").cast("int"), F.lit(0))).alias("rest"))
    first_other = F.array_position(F.transform("rest", lambda x: x.contains("|")), False)
    body = F.when(first_other > 0, F.slice("rest", 1, (first_other - 1).cast("int"))).otherwise(F.col("rest"))
    each = some.select(key, line_cells(F.col("head")).alias("header"), F.posexplode(body).alias("row", "line"))
    width = F.size("header")
    own = line_cells(F.col("line"))
    return each.select(key, "header", "row", F.slice(F.concat(own, F.array_repeat(F.lit(""), width)), F.lit(1), width).alias("cells"))


def table_of(spark: SparkSession, text: str) -> DataFrame | None:
    """The first piped table of one text as a frame: columns that are numbers in most filled cells are doubles. None: no table."""
    rows = table_rows(spark.createDataFrame([(0, text)], "k int, text string"), "k")
    first = rows.select("header").first()
    if first is None:
        return None
    names: list[str] = []
    for k, name in enumerate(first["header"]):
        base = name or f"col_{k + 1}"
        names.append(base if base not in names else f"{base}_{k + 1}")
    each = rows.orderBy("row").select(*[F.col("cells")[k].alias(n) for k, n in enumerate(names)])
    filled = lambda c: F.count_if(~blank_cell(F.col(f"`{c}`")))
    told = each.agg(*[x for c in names for x in (filled(c), F.count(F.when(~blank_cell(F.col(f"`{c}`")), cell_number(F.col(f"`{c}`")))))]).first()
    typed = [told[2 * k] > 0 and 5 * told[2 * k + 1] >= 4 * told[2 * k] for k in range(len(names))]
    return each.select(*[(F.when(~blank_cell(F.col(f"`{c}`")), cell_number(F.col(f"`{c}`"))) if t else F.col(f"`{c}`")).alias(c) for c, t in zip(names, typed, strict=True)])
