"""Guarded execution with caps that are always told, and the forms in which results leave."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.plans.guard import Refused, guard, items, name_of, parse
from veritab.plans.qualify import rewritten

ROWS, COLUMNS, SECONDS, CELL = 200, 24, 10.0, 80
SAVED_ROWS = 100_000


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    total: int | None
    reads: list[str] = field(default_factory=list)
    digest: str = ""

    @property
    def note(self) -> str:
        out = []
        if self.truncated:
            out.append(f"Showing the first {len(self.rows):,} rows of {f'{self.total:,}' if self.total is not None else 'more'}.")
        if len(self.columns) > COLUMNS:
            out.append(f"Showing {COLUMNS} of {len(self.columns)} columns.")
        return " ".join(out)


def within(spark: SparkSession, seconds: float, job):
    """Runs job() in a job group of its own that is cancelled when its time is up."""
    group = f"veritab-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "guarded query", True)
    timer.start()
    try:
        return job()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds:g} s") from None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def ordered(spark: SparkSession, sql: str) -> bool:
    """Whether the statement's own result has an order."""
    plan = parse(spark, sql)
    while name_of(plan) in ("GlobalLimit", "LocalLimit", "UnresolvedWith", "Project", "Offset"):
        plan = next(items(plan.children()))
    return name_of(plan) == "Sort"


def digest(rows: list[tuple], in_order: bool) -> str:
    """SHA-1 of the rows as CSV, doubles at nine digits; rows without an order are sorted first."""
    texts = [_csv([["" if v is None else f"{v:.9g}" if isinstance(v, float) else v for v in r]]) for r in rows]
    return hashlib.sha1("".join(texts if in_order else sorted(texts)).encode()).hexdigest()


def _csv(rows: list[list], end: str = "\r\n") -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def run_query(spark: SparkSession, sql: str, tables: list[str] | None = None, rows: int = ROWS, seconds: float = SECONDS) -> Result:
    """At most `rows` rows; if there are more, one count tells how many. No rows is an error. QUALIFY is rewritten first."""
    sql = rewritten(sql)
    names = guard(spark, sql, tables)
    df, found = within(spark, seconds, lambda: ((df := spark.sql(sql)), [tuple(r) for r in df.limit(rows + 1).collect()]))
    if not found:
        raise Refused("the query returned no rows")
    total: int | None = len(found)
    if len(found) > rows:
        try:
            total = within(spark, seconds, df.count)
        except TimeoutError:
            total = None
    shown = found[:rows]
    return Result(df.columns, shown, len(found) > rows, total, names, digest(found, ordered(spark, sql)))


def to_markdown(result: Result, rows: int = ROWS) -> str:
    def cell(v) -> str:
        text = ("" if v is None else str(v)).replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")
        return text if len(text) <= CELL else text[: CELL - 1] + "…"

    lines = [result.columns[:COLUMNS], ["---"] * len(result.columns[:COLUMNS]), *[r[:COLUMNS] for r in result.rows[:rows]]]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)


def to_csv(result: Result, end: str = "\r\n") -> str:
    """RFC 4180; null is empty. end: CRLF for files, LF for what a page shows."""
    return _csv([result.columns, *[["" if v is None else v for v in r] for r in result.rows]], end)


def to_json(result: Result, rows: int = 40) -> str:
    """{columns, rows} for display: at most 40 rows and 24 columns, every cell a string."""
    shown = [["" if v is None else str(v) for v in r[:COLUMNS]] for r in result.rows[:rows]]
    return json.dumps({"columns": result.columns[:COLUMNS], "rows": shown}, ensure_ascii=False)


def csv_lines(df: DataFrame, sep: str = ",") -> DataFrame:
    """(value): the rows as RFC 4180 lines without their ends. A cell with a quote, a separator or a line break is quoted, and its
    quotes are doubled; nothing else in it changes. Null is nothing between separators and the empty text two quotes, which readers may take as one."""

    def cell(name: str):
        text = F.col(f"`{name}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.isNull(), "").when((text == "") | text.rlike(f'["\r\n{sep}]') | text.rlike(r"^\s|\s$"), quoted).otherwise(text)

    return df.select(F.concat_ws(sep, *map(cell, df.columns)).alias("value"))


def save_csv(df: DataFrame, folder: str, name: str, rows: int = SAVED_ROWS) -> str:
    """Writes at most `rows` rows as one CSV file with CRLF line ends and gives its path; a name that is taken gets a number."""
    spark = df.sparkSession
    part = f"{folder.rstrip('/')}/_saving-{uuid.uuid4().hex}"
    head = spark.createDataFrame([(0, _csv([df.columns], ""))], "at long, value string")
    body = csv_lines(df.limit(rows)).select((F.monotonically_increasing_id() + 1).alias("at"), "value")
    one = head.union(body).repartition(1).sortWithinPartitions("at").select("value")
    one.write.option("lineSep", "\r\n").text(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    written = next(f.getPath() for f in store.listStatus(path(part)) if f.getPath().getName().startswith("part-"))
    base, k = name.removesuffix(".csv"), 1
    while True:
        target = path(f"{folder.rstrip('/')}/{base}{'' if k == 1 else f'-{k}'}.csv")
        if not store.exists(target) and store.rename(written, target):
            store.delete(path(part), True)
            return target.toString()
        k += 1
