"""Workbooks (.xlsx) as tables, folders as a table of files, and matrices of text as typed tables.

A workbook is zipped XML, which the standard library reads; each file is one row of a binaryFile scan, and its cells leave as
rows, so a folder of workbooks is read in parallel."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import number, sanitize
from veritab.sources.files import admitted, header_row
from veritab.sources.store import new_folder, written

#: What is read of a workbook, and how a column's kind is decided.
SHEETS, COLUMNS, ROWS = 4, 64, 100_000
NUMERIC_SHARE = 0.8
SERIALS = (20_000, 60_000)
#: Rows of small books that leave a task together.
TOGETHER = 10_000
CELLS = "path string, sheet string, row int, cells array<string>, place int"
DATED_NAMES = ("date", "day", "month", "time", "created", "updated", "modified", "dob", "birth", "expiry", "expire", "due", "_at", "timestamp", "datetime")
DATE_FORMATS = frozenset([14, 15, 16, 17, 22, 27, 30, 36, 50, 57])
_ROW, _CELL = re.compile(r"\d+$"), re.compile(r"^[A-Z]+")


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, extension, modified, length) of every file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.col("modificationTime").alias("modified"), "length")


def iso_of(serial: float, since_1904: bool = False) -> str:
    """The ISO date, or date and time, of a day's number; numbers outside the calendar stay as they are."""
    if not 0 <= serial <= 2_958_465:
        return plain(serial)
    at = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
    at += timedelta(days=int(serial), seconds=round(serial % 1 * 86_400))
    return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat(" ")


def plain(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheets_of(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells as text) of a workbook's first sheets: numbers without a zero fraction, TRUE and FALSE, ISO dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        read = lambda name: ElementTree.fromstring(book.read(name))
        shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter() if _local(f.tag) == "numFmt"}
            shows_date = lambda k: k in DATE_FORMATS or re.search(r"[dy]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", own.get(k, "")), re.I) is not None
            formats = next((x for x in styles if _local(x.tag) == "cellXfs"), [])
            dated = [shows_date(int(x.get("numFmtId") or 0)) for x in formats]
        workbook = read("xl/workbook.xml")
        since_1904 = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in workbook.iter())
        targets = {x.get("Id"): x.get("Target") for x in read("xl/_rels/workbook.xml.rels")}
        sheets = [x for x in workbook.iter() if _local(x.tag) == "sheet"][:SHEETS]
        for sheet in sheets:
            target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
                count = 0
                for _, row in ElementTree.iterparse(stream):
                    if _local(row.tag) != "row":
                        continue
                    cells: list[str] = []
                    for cell in row:
                        letters = _CELL.match(cell.get("r") or "")
                        at = len(cells) if not letters else sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1
                        if at >= COLUMNS:
                            continue
                        cells += [""] * (at + 1 - len(cells))
                        cells[at] = _text_of(cell, shared, dated, since_1904)
                    yield sheet.get("name") or "", count, cells
                    row.clear()
                    count += 1
                    if count > ROWS + 8:
                        break


def _text_of(cell, shared: list[str], dated: list[bool], since_1904: bool) -> str:
    kind = cell.get("t") or "n"
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind != "n" or not value:
        return value
    style = int(cell.get("s") or 0)
    return iso_of(float(value), since_1904) if style < len(dated) and dated[style] else plain(float(value))


def workbook_cells(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sheet, row, cells, place of the sheet) of workbook files; a file that can't be read gives no rows."""
    return cells_of(spark.read.format("binaryFile").load(list(paths)))


def cells_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cells of batches of workbooks (path, content), those of small ones together."""
    told = lambda rows: pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "place"])
    for batch in batches:
        # Small books leave together; a frame for each would cost more than reading it.
        out: list[tuple] = []
        for path, content in zip(batch.path, batch.content, strict=True):
            try:
                found = list(sheets_of(bytes(content)))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, StopIteration):
                continue
            places = {s: k for k, s in enumerate(dict.fromkeys(r[0] for r in found))}
            out += [(path, *r, places[r[0]]) for r in found]
            if len(out) >= TOGETHER:
                yield told(out)
                out = []
        if out:
            yield told(out)


def cells_of(books: DataFrame) -> DataFrame:
    """The same of workbooks (path, content) wherever they come from."""
    return books.select("path", "content").mapInPandas(cells_in, CELLS)


def typed(matrix: DataFrame, headers: list[str]) -> DataFrame:
    """A table of text columns from (row, cells), with each column's kind decided by one pass over all rows.

    A column of which 0.8 of the filled cells are numbers is double, other cells and numbers that are not finite being null; one
    whose name tells of a date and whose cells are all whole serial days is ISO text; all others are text."""
    names: list[str] = []
    for h in headers:
        base, k = sanitize(h) if h.strip() else f"col_{len(names) + 1}", 2
        name = base
        while name in names:
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    raw = matrix.select("row", *[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])
    value = {n: number(F.col(n)) for n in names}
    serial = {n: F.coalesce((value[n] == F.floor(value[n])) & value[n].between(*SERIALS), F.lit(False)) for n in names}
    votes = [v for n in names for v in (F.count_if(F.trim(n) != ""), F.count(value[n]), F.count_if(serial[n] & (F.trim(n) != "")))]
    told = raw.agg(*[v.alias(f"v{k}") for k, v in enumerate(votes)]).first()

    def column(k: int, n: str) -> Column:
        filled, numeric, serials = told[3 * k : 3 * k + 3]
        if filled and serials == filled and any(d in n for d in DATED_NAMES):
            return F.date_format(F.date_add(F.lit(date(1899, 12, 30)), value[n].cast("int")), "yyyy-MM-dd").alias(n)
        return (value[n] if filled and numeric >= NUMERIC_SHARE * filled else F.col(n)).alias(n)

    return raw.select("row", *[column(k, n) for k, n in enumerate(names)])


EXTENSIONS = (".xlsx", ".xlsm")


@dataclass
class Sheet:
    name: str
    data: DataFrame
    capped: tuple[int, int] | None
    header: list[str]
    rows: int


class Books:
    """Workbooks whose cells are read once, written to the shared folder, and then taken from there sheet by sheet."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark = spark
        self.cells = written(workbook_cells(spark, *paths), new_folder(spark, "cells"))
        own = F.element_at(F.split("path", "/"), -1)
        heads = self.cells.where("row < 8").orderBy("path", "sheet", "row").collect()
        sizes = {(r["path"], r["sheet"]): (r["n"], r["first"]) for r in self.cells.groupBy("path", "sheet").agg(F.max("row").alias("n"), F.min("place").alias("first")).collect()}
        self.sheets: dict[str, list[Sheet]] = {}
        self.at: dict[tuple[str, str], int] = {}
        told = {r["path"]: r["name"] for r in self.cells.select("path", own.alias("name")).distinct().collect()}
        by_path = {t: p for t in told for p in paths if t == p or t.removeprefix("file:").lstrip("/") == p.removeprefix("file:").lstrip("/")}
        for (path, sheet), (last, _) in sorted(sizes.items(), key=lambda x: (x[0][0], x[1][1])):
            first = [list(r["cells"]) for r in heads if (r["path"], r["sheet"]) == (path, sheet)]
            at = header_row(first)
            width = max(map(len, first), default=0)
            if width < 2 or last - at < 2 or path not in by_path:
                continue
            header = first[at] + [""] * (width - len(first[at]))
            rows = self.cells.where((F.col("path") == path) & (F.col("sheet") == sheet) & (F.col("row") > at) & (F.col("row") <= at + ROWS))
            self.at[path, sheet] = at
            one = Sheet(sheet, typed(rows, header).drop("row"), (ROWS, last - at) if last - at > ROWS else None, header, last - at)
            self.sheets.setdefault(by_path[path], []).append(one)
        self.path_of = {v: k for k, v in by_path.items()}

    def union(self, members: list[str], limit: int = ROWS) -> tuple[DataFrame | None, list[str], list[str]]:
        """(table, members in it, members left out) of the first sheets of a family, newest first: whole members while their rows
        stay within the limit. Members with another header than the newest are left out too. Fewer than two: no union."""
        found = [(k, p, self.sheets[p][0].rows, [h.strip().lower() for h in self.sheets[p][0].header]) for k, p in enumerate(members) if self.sheets.get(p)]
        alike = [m for m in found if m[3] == found[0][3]]
        frame = self.spark.createDataFrame([(k, p, n, "family") for k, p, n, _ in alike], "place int, member string, rows long, family string")
        within = {r["member"] for r in admitted(frame, limit, ["place"], ["family"]).where("within").collect()}
        kept = [p for p in members if p in within]
        if len(kept) < 2:
            return None, members[:1], members[1:]
        chosen = [(self.path_of[p], self.sheets[p][0].name, self.at[self.path_of[p], self.sheets[p][0].name], k) for k, p in enumerate(kept)]
        told = self.spark.createDataFrame(chosen, "path string, sheet string, at int, member int")
        rows = self.cells.drop("place").join(F.broadcast(told), ["path", "sheet"]).where("row > at")
        together = typed(rows.select((F.col("member") * (2 * ROWS) + F.col("row")).alias("row"), "cells"), self.sheets[kept[0]][0].header)
        return together.drop("row"), kept, [p for p in members if p not in kept]


def workbook_tables(spark: SparkSession, *paths: str) -> dict[tuple[str, str], tuple[DataFrame, int | None]]:
    """{(path, sheet): (table, rows in all if more than are kept)} of the sheets with two columns and two rows and more."""
    cells = written(workbook_cells(spark, *paths), new_folder(spark, "cells"))
    heads = cells.where("row < 8").orderBy("path", "sheet", "row").collect()
    sizes = {(r["path"], r["sheet"]): r["n"] for r in cells.groupBy("path", "sheet").agg(F.max("row").alias("n")).collect()}
    out = {}
    for key, last in sizes.items():
        first = [list(r["cells"]) for r in heads if (r["path"], r["sheet"]) == key]
        at = header_row(first)
        width = max(map(len, first), default=0)
        if width < 2 or last - at < 2:
            continue
        rows = cells.where((F.col("path") == key[0]) & (F.col("sheet") == key[1]) & (F.col("row") > at) & (F.col("row") <= at + ROWS))
        out[key] = typed(rows, first[at] + [""] * (width - len(first[at]))), last - at if last - at > ROWS else None
    return out
