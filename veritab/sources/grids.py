"""Tables found in laid-out text: rows, cells and columns from the places of glyphs, by windows and a sweep over gaps.

Takes glyphs (page, x, y, w, fs, text): left edge, baseline (larger is higher), width, font size, text. A table is reported only
where it is plain: a gutter must be open in most rows and most rows must fit the columns. A page is one group; its glyphs
meet in windows by page and row, and nothing of a page is collected but its distinct baselines and its few column bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.sources.store import new_folder, written

#: Fixed values, in units of the page's median font size: what parts cells, words and rows, and the least gutter.
CELL_GAP, SPACE_GAP, ROW_STEP, GUTTER_WIDTH = 1.1, 0.28, 0.6, 0.3
#: Shares of rows that a gutter must span and that must fit, and the least and most rows, columns and glyphs.
GUTTER_SHARE, FIT_SHARE = 0.6, 0.7
LEAST_ROWS, LEAST_COLUMNS, MOST_COLUMNS, SHOWN_ROWS, MOST_GLYPHS, QUERYABLE_ROWS = 2, 2, 24, 120, 80_000, 3


def numeric_cell(text: Column) -> Column:
    """Whether a cell is a number under currency signs, separators, percent signs and brackets."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), "^[$£€¥]+", ""), r"[,%() ]", ""), "^-+", "")
    return (bare != "") & bare.try_cast("double").isNotNull()


def median_sizes(glyphs: DataFrame, page: str) -> DataFrame:
    """(page, med): the upper median of positive font sizes, from counts by size."""
    sizes = glyphs.where("fs > 0").groupBy(page, "fs").agg(F.count("*").alias("n"))
    order = Window.partitionBy(page).orderBy("fs")
    placed = sizes.select(page, "fs", F.sum("n").over(order).alias("up_to"), F.sum("n").over(Window.partitionBy(page)).alias("all"))
    return placed.where(F.col("up_to") > F.floor(F.col("all") / 2)).groupBy(page).agg(F.min("fs").alias("med"))


def baselines(glyphs: DataFrame, page: str) -> DataFrame:
    """(page, y, row): baselines from the top down; one within ROW_STEP of its row's first baseline is of that row.

    A row's extent follows from its first baseline, so a page's distinct baselines are folded in order."""
    whole = glyphs.groupBy(page).agg(F.sort_array(F.collect_set("y"), asc=False).alias("ys"), F.max("med").alias("med"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def put(state: Column, y: Column) -> Column:
        new = state["top"].isNull() | (state["top"] - y > ROW_STEP * F.col("med"))
        row = F.when(new, state["row"] + 1).otherwise(state["row"])
        return F.struct(F.when(new, y).otherwise(state["top"]).alias("top"), row.alias("row"), F.concat(state["rows"], F.array(row)).alias("rows"))

    folded = whole.select(page, "ys", F.aggregate("ys", start, put)["rows"].alias("rows"))
    return folded.select(page, F.explode(F.arrays_zip(F.col("ys").alias("y"), F.col("rows").alias("row"))).alias("z")).select(page, "z.y", "z.row")


def row_cells(glyphs: DataFrame, page: str) -> DataFrame:
    """(page, row, x0, x1, text, med): runs of glyphs of a row without a gap of a cell's width; smaller gaps are spaces."""
    placed = glyphs.join(baselines(glyphs, page), [page, "y"])
    order = Window.partitionBy(page, "row").orderBy("x", F.desc("y"), "w", "text")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    stepped = placed.withColumn("gap", gap).withColumn("nth", F.row_number().over(order))
    cut = stepped.withColumn("cell", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") >= CELL_GAP * F.col("med")), 1).otherwise(0)).over(order))
    part = F.concat(F.when(F.col("gap") > SPACE_GAP * F.col("med"), " ").otherwise(""), "text")
    cells = cut.groupBy(page, "row", "cell").agg(
        F.min("x").alias("x0"),
        F.max_by(F.col("x") + F.col("w"), "nth").alias("x1"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", part.alias("part")))), lambda s: s["part"]), "").alias("text"),
        F.max("med").alias("med"),
    )
    plain = F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " "))
    return cells.withColumn("text", plain).where("text <> ''").select(page, "row", "x0", "x1", "text", "med")


def column_bounds(cells: DataFrame, page: str) -> DataFrame:
    """(page, bounds): middles of the stretches that lie between cells in enough rows, by a sweep over the gaps' ends."""
    order = Window.partitionBy(page, "row").orderBy("x0")
    gaps = cells.select(page, "row", "med", F.lag("x1").over(order).alias("lo"), F.col("x0").alias("hi")).where(F.col("hi") > F.col("lo"))
    ends = gaps.select(page, "med", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    sweep = Window.partitionBy(page).orderBy("x")
    steps = ends.groupBy(page, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"), F.max("med").alias("med"))
    rows = cells.groupBy(page).agg(F.count_distinct("row").alias("n"))
    open_ = steps.select(page, "x", "med", F.sum("d").over(sweep).alias("cover"), F.lead("x").over(sweep).alias("to")).where(F.col("to").isNotNull()).join(rows, page)
    held = F.col("cover") >= F.ceil(GUTTER_SHARE * F.col("n"))
    runs = open_.withColumn("held", held).withColumn("run", F.sum(F.when(F.col("held"), 0).otherwise(1)).over(sweep)).where("held")
    gutters = runs.groupBy(page, "run").agg(F.min("x").alias("lo"), F.max("to").alias("hi"), F.max("med").alias("med")).where(F.col("hi") - F.col("lo") >= GUTTER_WIDTH * F.col("med"))
    return gutters.groupBy(page).agg(F.sort_array(F.collect_list((F.col("lo") + F.col("hi")) / 2)).alias("bounds"))


def grids(glyphs: DataFrame, page: str = "page", shown: int | None = SHOWN_ROWS) -> DataFrame:
    """(page, row, cells, rows, header, queryable): the rows of each page's table from the top, as arrays of one text a column;
    rows tells how many the table has, of which the first `shown` are given (None: all). header: the first row has a text in
    every column and no number; queryable: so it has, and three rows and more below.

    Pages without a plain table have no rows. Null texts and places are left out; a page of more than 80,000 glyphs has no
    table."""
    plain = glyphs.select(page, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "fs")], "text").where("text IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND trim(text) <> ''")
    sizes = median_sizes(plain, page).join(plain.groupBy(page).agg(F.count("*").alias("_n")).where(F.col("_n") <= MOST_GLYPHS), page).drop("_n")
    # Bounds, rows and the table's own test all rest on the cells, which are put together once.
    cells = written(row_cells(plain.join(sizes, page), page), new_folder(glyphs.sparkSession, "cells"))
    middle = (F.col("x0") + F.col("x1")) / 2
    bounds = column_bounds(cells, page).where(F.size("bounds").between(LEAST_COLUMNS - 1, MOST_COLUMNS - 1))
    placed = cells.join(bounds, page).withColumn("column", F.size(F.filter("bounds", lambda b: middle >= b)))
    joined = placed.groupBy(page, "row", "column").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"), F.max(F.size("bounds") + 1).alias("columns"))
    rows = joined.groupBy(page, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m"), F.max("columns").alias("columns"), F.sum("n").alias("cells_"), F.max("n").alias("most"))
    rows = rows.select(page, "row", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))).alias("cells"), ((F.col("most") == 1) & (F.col("cells_") >= 2)).alias("clean"))
    filled = F.size(F.filter("cells", lambda c: c != ""))
    table = rows.groupBy(page).agg(F.count("*").alias("rows"), F.count_if("clean").alias("clean_rows"), F.bool_or(filled >= 2).alias("wide"), F.min_by("cells", "row").alias("first"))
    table = table.where((F.col("rows") >= LEAST_ROWS) & (F.col("clean_rows") / F.col("rows") >= FIT_SHARE) & F.col("wide"))
    header = F.forall("first", lambda c: c != "") & ~F.exists("first", numeric_cell)
    table = table.select(page, "rows", header.alias("header"), (header & (F.col("rows") > QUERYABLE_ROWS)).alias("queryable"))
    nth = F.row_number().over(Window.partitionBy(page).orderBy("row")).cast("int")
    out = rows.join(table, page).select(page, nth.alias("row"), "cells", "rows", "header", "queryable")
    return out if shown is None else out.where(F.col("row") <= shown)
