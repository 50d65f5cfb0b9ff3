"""Grids, sorted and parsed tables, reports, listings, inspections, vectors, direct runs and workbook unions."""

import functools
import io
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_cards_and_charts import _workbook
from veritab.operators import listing, recipes, report
from veritab.operators.index_store import IndexStore
from veritab.operators.vectors import VectorSidecar
from veritab.plans import shown
from veritab.operators.charts import auto_chart
from veritab.plans.direct import run_direct, save_direct
from veritab.plans.guard import Refused
from veritab.sources import workbooks
from veritab.sources.files import admitted, register, uncovered
from veritab.sources.grids import grids
from veritab.sources.workbooks import Books

GLYPHS = "page int, x double, y double, w double, fs double, text string"


def plain_grid(glyphs):
    """The rows of one page's table, or None, by lists and loops."""
    sizes = sorted(g[3] for g in glyphs if g[3] > 0)
    if not sizes:
        return None
    med = sizes[len(sizes) // 2]
    rows = []
    for g in sorted(glyphs, key=lambda g: (-g[1], g[0])):
        if rows and abs(rows[-1][0][1] - g[1]) <= 0.6 * med:
            rows[-1].append(g)
        else:
            rows.append([g])
    cells = []
    for row in rows:
        row.sort(key=lambda g: (g[0], -g[1], g[2], g[4]))
        own, end = [], None
        for x, _, w, _, text in row:
            if end is not None and x - end < 1.1 * med:
                own[-1][2] += (" " if x - end > 0.28 * med else "") + text
                own[-1][1] = x + w
            else:
                own.append([x, x + w, text])
            end = x + w
        own = [[a, b, " ".join(t.split())] for a, b, t in own if t.strip()]
        if own:
            cells.append(own)
    if len(cells) < 2:
        return None
    gaps = [(a[1], b[0]) for row in cells for a, b in zip(row, row[1:]) if b[0] > a[1]]
    xs = sorted({x for g in gaps for x in g})
    bounds, run = [], None
    for lo, hi in zip(xs, xs[1:]):
        if sum(a <= lo and hi <= b for a, b in gaps) >= np.ceil(0.6 * len(cells)):
            run = (run[0] if run else lo, hi)
        elif run:
            bounds, run = bounds + [run], None
    bounds = [(a + b) / 2 for a, b in bounds + ([run] if run else []) if b - a >= 0.3 * med]
    if not 1 <= len(bounds) <= 23:
        return None
    out, clean = [], 0
    for row in cells:
        line = [[] for _ in range(len(bounds) + 1)]
        for a, b, t in row:
            line[sum((a + b) / 2 >= x for x in bounds)].append(t)
        clean += len(row) >= 2 and max(map(len, line)) == 1
        out.append([" ".join(c) for c in line])
    if clean / len(cells) < 0.7 or all(sum(map(bool, r)) < 2 for r in out):
        return None
    return out


def test_grids_equal_plain_loops(spark):
    r = random.Random(4)
    pages = {1: [(100.0, 700.0, 300.0, 10.0, "the quick brown"), (100.0, 686.0, 280.0, 10.0, "fox and more")], 2: [(100.0, 700.0, 40.0, 10.0, "Apples"), (100.0, 680.0, 44.0, 10.0, "Pears")]}
    for page in range(3, 60):
        columns, glyphs = r.randint(1, 5), []
        for row in range(r.randint(1, 9)):
            y = 700.0 - 14 * row
            for c in range(columns):
                if r.random() < 0.9:
                    x = 50.0 + 110 * c + r.choice([0, 0, 30, 70 if r.random() < 0.2 else 10])
                    for word in range(r.randint(1, 3)):
                        w = float(r.randint(8, 24))
                        glyphs.append((x, y + r.choice([0, 0, 2.5, -2.0]), w, r.choice([10.0, 10.0, 9.0]), r.choice(["Ab", "12", "$3.5", "x y", "né"])))
                        x += w + r.choice([1.0, 4.0, 12.0 if r.random() < 0.1 else 3.0])
        pages[page] = glyphs
    rows = [(p, *g) for p, gs in pages.items() for g in gs] + [(1, None, 5.0, 1.0, 10.0, "lost"), (2, 1.0, 5.0, 1.0, 10.0, None), (None, 1.0, 1.0, 1.0, 10.0, "a")]
    found = {}
    for x in grids(spark.createDataFrame(rows, GLYPHS), shown=None).orderBy("page", "row").collect():
        found.setdefault(x.page, []).append(x.cells)
    want = {p: g for p, gs in pages.items() if (g := plain_grid(gs))}
    assert found == want and len(want) > 20


def test_grids_tell_headers_and_cut_rows(spark):
    cell = lambda x, y, t: (1, x, y, 20.0, 10.0, t)
    rows = [cell(100.0, 700.0, "Region"), cell(250.0, 700.0, "Total")] + [c for k in range(4) for c in (cell(100.0, 680.0 - 20 * k, f"r{k}"), cell(250.0, 680.0 - 20 * k, f"({k})"))]
    got = grids(spark.createDataFrame(rows, GLYPHS), shown=2).orderBy("row").collect()
    assert [(x.cells, x.rows, x.header, x.queryable) for x in got] == [(["Region", "Total"], 5, True, True), (["r0", "(0)"], 5, True, True)]
    data = grids(spark.createDataFrame(rows[2:], GLYPHS)).first()
    assert not data.header and not data.queryable
    assert grids(spark.createDataFrame([], GLYPHS)).count() == 0


def plain_compare(a, b):
    import re

    def number(s):
        s = s.strip()
        s = re.sub(r"[$€£¥₩₹¢₽¤,\s]", "", s[:-1] if s.endswith("%") else s)
        try:
            return float(s) if s and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else None
        except ValueError:
            return None

    x, y = number(a), number(b)
    if (x is None) != (y is None):
        return 1 if x is None else -1
    if x is not None:
        return (x > y) - (x < y)
    key = lambda s: [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"\d+|\D+", s)]
    return (key(a) > key(b)) - (key(a) < key(b))


@pytest.mark.parametrize("down", [False, True])
def test_sorted_tables(spark, down):
    r = random.Random(8)
    cells = [r.choice(["$1,200", "1200", "3.5%", "-42", "item2", "Item10", "ITEM1", "item002", "apple", "Banana", "", "—", "-", "null", " ", None, "7", "7.0", "1e3", "a1b20", "a1b3"]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(cells)), "place int, v string").repartition(5)
    got = [x.place for x in shown.with_positions(shown.sort_rows(df, "v", down, "place")).orderBy("position").collect()]
    blank = lambda v: v is None or v.strip() in ("", "-", "—", "null")
    filled = [i for i, v in enumerate(cells) if not blank(v)]
    filled.sort(key=functools.cmp_to_key(lambda i, j: (-1 if down else 1) * plain_compare(cells[i], cells[j]) or i - j))
    assert got == filled + [i for i, v in enumerate(cells) if blank(v)]
    assert [x.position for x in shown.with_positions(df.orderBy("place")).orderBy("place").collect()] == list(range(1, 121))


def test_tables_in_texts(spark):
    text = "Intro | x\n\n| A | B\\|c | n |\r\n|---|:--|---:|\n| 1 | two \\\\ | $3 |\n| x |\n| 2 | y | 4 | 5 |\nend\n| not | here | 1 |"
    rows = shown.table_rows(spark.createDataFrame([(1, text), (2, "no table"), (3, None), (4, "a | b\n--- | ---\n1 | 2"), (5, "| only | head |\n|---|---|")], "k int, text string"), "k")
    assert sorted((x.k, x.row, x.cells) for x in rows.collect()) == [(1, 0, ["1", "two \\", "$3"]), (1, 1, ["x", "", ""]), (1, 2, ["2", "y", "4"]), (4, 0, ["1", "2"])]
    table = shown.table_of(spark, "| month | total |\n|---|---|\n| 2024-01 | $1,000 |\n| 2024-02 | 2,500 |\n| 2024-03 | — |\n")
    assert table.dtypes == [("month", "string"), ("total", "double")]
    chart = auto_chart(table)
    assert chart.kind == "area" and [tuple(x) for x in chart.rows.collect()] == [("2024-01", 1000.0), ("2024-02", 2500.0), ("2024-03", None)]
    assert shown.table_of(spark, "nothing") is None
    odd = ["a|b\\", "\\|", "", "x\ny", " | ", "\\\\|\\"]
    line = spark.range(1).select(shown.line_cells(shown.piped_line(*map(F.lit, odd)))).first()[0]
    assert line == [c.replace("\n", " ").strip() for c in odd]


def test_a_report_reads_its_table_once_and_gives_the_recipes_rows(spark):
    r = random.Random(2)
    rows = [(f"20{y:02d}-{m:02d}-{r.randint(1, 28):02d}", r.choice(["a", "b", "c", None]), round(r.gauss(100, 30) * (3 if (y, m) == (21, 5) else 1), 2) if r.random() < 0.95 else None, r.randint(0, 5)) for y in (20, 21) for m in range(1, 13) for _ in range(12)] + [(None, "a", 1.0, 1)]
    df = spark.createDataFrame(rows, "d string, kind string, v double, n int").withColumn("d", F.to_date("d")).select("d", "v", "kind", "n").cache()
    facts = report.Facts(df, "d", "v", "kind")
    plan = facts.plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1
    want = {"variance-vs-last-period": recipes.variance_vs_last_period(df, "d", "v"), "cohort-breakdown": recipes.cohort_breakdown(df, "kind", "v"), "data-quality-audit": recipes.data_quality(df), "anomaly-scan": recipes.anomaly_scan(df, "d", "v"), "top-movers": recipes.top_movers(df, "kind", "v", "d"), "forecast": recipes.forecast(df, "d", "v"), "changepoint-scan": recipes.changepoint_scan(df, "d", "v")}
    for name, rows_ in report.sections(facts, True).items():
        assert sorted(map(str, rows_.collect())) == sorted(map(str, want[name].collect())), name
    told = report.investigate("sales", df)
    assert [s.recipe for s in told.sections] == list(want) and told.caveats[0] == report.PARTIAL_MONTH
    for form in report.TEMPLATES:
        assert report.render(told, form) == report.render(report.investigate("sales", df.repartition(3)), form)
    bare = report.investigate("plain", df.select("kind"))
    assert not bare.sections and "_no rows_" in report.render(bare)


ASKS = {"Show me all files": [], "list my datasets": list(listing.DATASETS), "how many documents are there?": list(listing.DOCUMENTS), "which pdf": None, "list every PDF": [".pdf"], "what files mention budgets": None, "list the csv parquet files": [".csv", ".parquet"], "What is the total of orders?": None, "give me spreadsheets": list(listing.NOUNS["spreadsheet"]), "": None, "files": None}


def test_questions_for_lists(spark):
    df = spark.createDataFrame([(q,) for q in ASKS] + [(None,)], "q string")
    got = {x.q: x.e for x in df.select("q", listing.listing_extensions(F.col("q")).alias("e")).collect()}
    assert got.pop(None) is None
    assert {q: sorted(e) if e is not None else None for q, e in got.items()} == {q: sorted(e) if e is not None else None for q, e in ASKS.items()}
    files = spark.createDataFrame([(f"f{k:03d}.csv",) for k in range(60)] + [("a.PDF",), ("noext",)], "name string")
    rows = [tuple(x) for x in listing.listed(files, [".csv"]).collect()]
    assert len(rows) == 50 and rows[0] == ("f000.csv", 60) and listing.listing_text(rows, "CSV files").splitlines()[-1] == "…and 10 more"
    assert [tuple(x) for x in listing.listed(files, [".pdf"]).collect()] == [("a.PDF", 1)] and listing.listed(files, []).first().of == 62
    assert listing.listing_text([]) == "No files found."


def test_asks_of_the_newest_tables(spark):
    one = spark.createDataFrame([("x", 1.0)], "region string, amount double")
    two = one.withColumn("day", F.current_date())
    got = listing.suggested_asks([("old", one, 1.0), ("new", two, 9.0), ("mid", spark.createDataFrame([("x",)], "name string"), 5.0), ("mid2", one, 4.0)])
    assert got == [("Total amount by region", "Total amount by region in new"), ("Monthly trend of amount", "Monthly trend of amount in new")]


def test_inspection_builds_nothing(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    schema = "file string, name string, version string, text string"
    old = spark.createDataFrame([("a", "a.csv", "1", "alpha budget"), ("b", "b.md", "1", "beta")], schema)
    store.refresh(old)
    now = spark.createDataFrame([("a", "a.csv", "2", "alpha budget new"), ("b", "b.md", "1", "beta"), ("c", "c", None, None)], schema)
    got = {x.file: tuple(x)[2:] for x in listing.inspections(now, store.snapshot()).collect()}
    assert got == {"a": ("tabular", "alpha budget new", 1, "1", False), "b": ("prose", "beta", 1, "1", True), "c": ("prose", None, None, None, None)}
    assert store.commits() == [1] and listing.inspections(now).where("chunks IS NOT NULL").count() == 0
    assert [(x.ordinal, x.chunk) for x in listing.search_file(store.snapshot(), "a", ["budget"]).collect()] == [(0, "alpha budget")]
    assert listing.search_file(store.snapshot(), "b", ["budget"]).count() == 0


def test_packed_vectors_find_the_exact_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 24))
    data[7] = data[8]
    data[9] = 0
    rows = [(i, [float(x) for x in v], "1") for i, v in enumerate(data)] + [(900, None, "1")]
    schema = "vec_id int, embedding array<double>, version string"
    df = spark.createDataFrame(rows, schema)
    side = VectorSidecar(spark, str(tmp_path / "v"))
    assert side.refresh(df) == 600 and side.refresh(df) == 0
    queries = df.where("vec_id % 50 = 7").select(F.col("vec_id").alias("query"), "embedding")
    got = {}
    for x in side.nearest(df.where("vec_id <> 900"), queries).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append(x.vec_id)
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    hit = total = 0
    for q, ids in got.items():
        exact = sorted(range(600), key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:10]
        hit, total = hit + len(set(exact) & set(ids)), total + 10
        assert ids[0] in (q, 7)
    assert hit / total >= 0.99
    changed = df.where("vec_id < 500").withColumn("version", F.when(F.col("vec_id") < 5, "2").otherwise("1"))
    assert side.refresh(changed) == 5 and side.live.count() == 500


def test_no_neighbour_is_lost_among_very_close_vectors(spark, tmp_path):
    """Three hundred vectors that packed bytes cannot tell apart, many copies, and a zero vector."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    data = np.concatenate([base + rng.normal(size=(300, 16)) * 2e-3, np.tile(rng.normal(size=16), (80, 1)), np.zeros((1, 16)), rng.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, [float(x) for x in v], "1") for i, v in enumerate(data)], "vec_id int, embedding array<double>, version string")
    side = VectorSidecar(spark, str(tmp_path / "v"))
    side.refresh(df)
    queries = df.where("vec_id % 37 = 0 AND vec_id <> 380").select(F.col("vec_id").alias("query"), "embedding")
    got = {}
    for x in side.nearest(df, queries).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append(x.vec_id)
    for q, ids in got.items():
        score = [float(v @ data[q]) / (np.linalg.norm(v) * np.linalg.norm(data[q])) if v.any() else -9.0 for v in data]
        assert ids == sorted(range(len(data)), key=lambda i: (-round(score[i], 6), i))[:10]


def test_direct_runs_cover_their_files_and_say_so(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("region,amount\nnorth,10\nsouth,20\nsouth,7\n")
    spark.createDataFrame([("north", 1)], "region string, k int").write.parquet(str(tmp_path / "zones.parquet"))
    files = [str(tmp_path / n) for n in ("sales.csv", "zones.parquet", "gone.csv")]
    sql = "SELECT region, sum(amount) AS total FROM sales GROUP BY region"
    found = run_direct(spark, sql, files)
    assert sorted(found.result.rows) == [("north", 10), ("south", 27)] and found.chart.kind == "bar"
    assert found.footer[0].startswith("Based on sales (saved ") and found.footer[-1].startswith("1 of the files")
    assert run_direct(spark, sql, files[:1], rows=1).footer[1] == "Showing the first 1 rows of 2."
    with pytest.raises(Refused):
        run_direct(spark, "SELECT k FROM zones", files, allowed=lambda f: "zones" not in f)
    saved = save_direct(spark, sql + " QUALIFY row_number() OVER (ORDER BY sum(amount) DESC) = 1", files[:1], str(tmp_path), "out.csv")
    with open(saved.path.removeprefix("file:"), newline="") as f:
        assert f.read() == "region,total\r\nsouth,27\r\n"


def test_whole_workbooks_are_admitted_newest_first(spark, tmp_path):
    for k, n in enumerate((3, 4, 2, 5)):
        _workbook(tmp_path / f"sales-2024-0{k + 1}.xlsx", [["Region", "Amount"], *[[f"r{k}", k * 10 + i] for i in range(n)]])
    _workbook(tmp_path / "sales-2023-01.xlsx", [["Region", "Sum"], ["x", 1], ["y", 2]])
    newest = [str(tmp_path / f"sales-2024-0{k}.xlsx") for k in (4, 3, 2, 1)]
    books = Books(spark, [*newest, str(tmp_path / "sales-2023-01.xlsx")])
    table, kept, left = books.union(newest, 11)
    assert kept == newest[:3] and left == newest[3:] and sorted(x.amount for x in table.collect()) == [10.0, 11.0, 12.0, 13.0, 20.0, 21.0, 30.0, 31.0, 32.0, 33.0, 34.0]
    assert books.union(newest, 8)[1] == newest[:2] and books.union(newest, 6)[0] is None
    assert books.union([*newest[:1], str(tmp_path / "sales-2023-01.xlsx")])[0] is None
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n")
    found = register(spark, [*newest, str(tmp_path / "plain.csv"), str(tmp_path / "sales-2023-01.xlsx")])
    by = {r.table: r for r in found}
    assert by["sales_all"].family and len(by["sales_all"].files) == 4 and spark.table("sales_all").count() == 14 and {"plain", "sales_2023_01"} <= set(by)
    assert uncovered(newest, found) == 0
    frame = spark.createDataFrame([("a", 3, 5), ("a", 2, 4), ("a", 1, 1), ("b", 1, 99)], "g string, day int, rows long")
    assert {(x.g, x.day): x.within for x in admitted(frame, 9, [F.desc("day")], ["g"]).collect()} == {("a", 3): True, ("a", 2): True, ("a", 1): False, ("b", 1): False}


def test_small_workbooks_leave_a_task_together():
    """Hundreds of workbooks of a few rows are one frame of cells, and one that can't be read takes none with it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", "<worksheet><sheetData><row><c><v>1</v></c></row><row><c><v>2</v></c></row></sheetData></worksheet>")
    books = [(f"{k}.xlsx", b"no zip" if k == 7 else out.getvalue()) for k in range(300)]
    (found,) = workbooks.cells_in(iter([pd.DataFrame(books, columns=["path", "content"])]))
    assert len(found) == 598 and set(found.path) == {p for p, _ in books} - {"7.xlsx"}
    assert [list(c) for c in found[found.path == "9.xlsx"].cells] == [["1"], ["2"]]
