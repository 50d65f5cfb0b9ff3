"""Registration of files as views: formats, sanitised headers, kinds, families and join hints."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritab.functions.text import sanitize
from veritab.operators.recipes import kinds

TEXT = {"header": "true", "inferSchema": "true", "quote": '"', "escape": '"'}
FORMATS = {".csv": ("csv", TEXT), ".tsv": ("csv", TEXT | {"sep": "\t"}), ".parquet": ("parquet", {})}
FILE_SLOTS, TABLES, FAMILY = 4, 6, 48
#: Column names too general to suggest a join.
GENERAL = ("id", "name", "date", "value", "amount", "total", "count", "n", "status", "type", "category", "notes", "note", "priority", "active", "description", "comment", "created_at", "updated_at", "month", "year", "quarter", "label", "key", "code")


@dataclass
class Registered:
    table: str
    files: list[str]
    columns: dict[str, str]
    family: bool = False
    data: DataFrame | None = field(default=None, repr=False)
    #: (rows read, rows in all) where the table has only the first rows of a file.
    capped: tuple[int, int] | None = None
    #: Older files of a family that were left out whole, as their rows would pass the limit.
    omitted: list[str] = field(default_factory=list)


def line_options(spark: SparkSession, *paths: str) -> dict[str, str]:
    """How text files must be read whose quoted cells span lines, as whole files with the line end that their rows have; nothing
    for other files. Some line then has an odd number of quotes; the search stops at the first."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    if lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty():
        return {}
    return {"multiLine": "true", "lineSep": "\r\n" if lines.first()["value"].endswith("\r") else "\n"}


def read_file(spark: SparkSession, *paths: str, like: StructType | None = None) -> DataFrame | None:
    """One frame of files of one format with sanitised, distinct column names; None for other formats and bad files.

    like: the schema of a file of the same kind, so that text files are not read once more to tell their types. Quotes are
    doubled inside quoted cells, as RFC 4180 has it. A file with line breaks inside cells is read whole by one task, as no
    place in it is known to begin a row; all others are split."""
    form = FORMATS.get(os.path.splitext(paths[0])[1].lower())
    if not form:
        return None
    reader = spark.read.format(form[0]).options(**form[1])
    try:
        if form[0] == "csv":
            reader = reader.options(**line_options(spark, *paths))
        df = (reader.schema(like) if like is not None and form[0] == "csv" else reader).load(list(paths))
    except Exception:
        return None
    names: list[str] = []
    for c in df.columns:
        base, k = sanitize(c), 2
        name = base
        while name in names:
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    return df.toDF(*names)


def stem(path: str) -> str:
    """A file's name without digits and separators around them, which its family shares."""
    return re.sub(r"[\d_\-. ]+$", "", re.sub(r"[\d]+", "", os.path.splitext(os.path.basename(path))[0])).strip("_-. ")


def families(files: list[tuple[str, dict[str, str], int]]) -> tuple[list[list[str]], list[str]]:
    """(families, singles) of (path, columns, mtime): same extension, stem and ordered columns; newest first."""
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for path, columns, mtime in files:
        groups.setdefault((os.path.splitext(path)[1].lower(), stem(path).lower(), tuple(columns.items())), []).append((mtime, path))
    out, singles = [], []
    for (_, name, _), members in groups.items():
        members.sort(key=lambda m: (-m[0], m[1]))
        if len(members) >= 2 and len(name) >= 2:
            out.append([p for _, p in members[:FAMILY]])
        else:
            singles += members
    return out, [p for _, p in sorted(singles, key=lambda m: (-m[0], m[1]))]


def saved_at(path: str) -> float | None:
    """When a local file was saved, in seconds since the epoch; None if that is not known."""
    return os.path.getmtime(path) if os.path.exists(path) else None


def admitted(members: DataFrame, limit: int, order: list, by: list[str]) -> DataFrame:
    """The members (rows, and the columns of by and order) with `within`: whether a whole member is in the union of those that
    share `by`. Members come in order while the sum of their rows stays within the limit; the first that would pass it and
    all after it stay out, so that no member is in by half."""
    running = F.sum("rows").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return members.withColumn("within", running <= limit)


def register(spark: SparkSession, paths: list[str], slots: int = FILE_SLOTS, most: int = TABLES, local_only: frozenset[str] | set[str] = frozenset(), cloud: bool = False) -> list[Registered]:
    """Views over families first, then over single files, newest first; files that can't be read are left out, and those that
    must stay local where the answer leaves the machine. Every text file is read once to tell its types. A workbook is
    represented by its first sheet; its further sheets follow as tables of their own while there is room."""
    from veritab.sources.workbooks import EXTENSIONS, Books

    open_to = [p for p in paths if not (cloud and p in local_only)]
    of_books = [p for p in open_to if os.path.splitext(p)[1].lower() in EXTENSIONS]
    books = Books(spark, of_books) if of_books else None
    frames = {p: df for p in open_to if p not in of_books and (df := read_file(spark, p)) is not None}
    frames |= {p: books.sheets[p][0].data for p in of_books if books.sheets.get(p)}
    seen = [(p, kinds(df), int(os.path.getmtime(p) * 1000) if os.path.exists(p) else 0) for p, df in frames.items()]
    grouped, singles = families(seen)
    used: set[str] = set()
    out: list[Registered] = []
    for members, family in [*((g, True) for g in grouped), *(([s], False) for s in singles)][:slots]:
        capped, omitted = None, []
        if members[0] in of_books:
            if family:
                df, members, omitted = books.union(members)
                if len(members) < 2:
                    family = False
            if not family:
                df, capped = books.sheets[members[0]][0].data, books.sheets[members[0]][0].capped
        else:
            df = read_file(spark, *members, like=frames[members[0]].schema) if family else frames[members[0]]
        if df is None or len(out) >= most:
            continue
        base = sanitize(stem(members[0]) + "_all" if family else os.path.splitext(os.path.basename(members[0]))[0])
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        df.createOrReplaceTempView(name)
        out.append(Registered(name, members, kinds(df), family, df, capped, omitted))
        for sheet in books.sheets[members[0]][1:] if members[0] in of_books and not family else ():
            if len(out) < most:
                more = sanitize(f"{base}_{sheet.name}")
                if more not in used:
                    used.add(more)
                    sheet.data.createOrReplaceTempView(more)
                    out.append(Registered(more, members, kinds(sheet.data), False, sheet.data, sheet.capped))
    return out


def uncovered(paths: list[str], registered: list[Registered]) -> int:
    """Files that no registered table represents."""
    return len(set(paths) - {f for r in registered for f in r.files})


def join_hints(registered: list[Registered], most: int = 12) -> list[str]:
    """`a.k = b.k` for each telling column name that two tables share."""
    out = []
    for a, b in combinations(registered, 2):
        for c in a.columns:
            if c in b.columns and c not in GENERAL and not re.fullmatch(r"col_\d+", c):
                out.append(f"{a.table}.{c} = {b.table}.{c}")
    return out[:most]


def header_row(rows: list[list[str]]) -> int:
    """The header among the first eight rows: most telling is all text, then most text; at least two cells, half text."""

    def numeric(x: str) -> bool:
        try:
            float(x.replace(",", ""))
            return True
        except ValueError:
            return False

    best, at = (False, 0), 0
    for i, row in enumerate(rows[:8]):
        cells = [c for c in row if c and c.strip()]
        texts = sum(not numeric(c) for c in cells)
        if len(cells) >= 2 and 2 * texts >= len(cells) and (texts == len(cells), texts) > best:
            best, at = (texts == len(cells), texts), i
    return at
