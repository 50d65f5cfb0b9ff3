"""Charts, cards, stores, retrieval and workbooks on small tables."""

import datetime
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from veritab.functions import text as fx
from veritab.operators import charts, recipes, retrieval, rules, stores
from veritab.operators.semantic import Catalog, closure, ledger, propose_synonyms
from veritab.plans import cards, execute
from veritab.plans.execute import run_query
from veritab.plans.guard import Refused, guard, parse
from veritab.sources import files, workbooks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("schema", "rows", "kind"),
    [
        ("month string, total double", [("2024-01", 1.0), ("2024-02", 2.0)], "area"),
        ("yr int, total double", [(2023, 1.0), (2024, 2.0)], "area"),
        ("month string, a double, b double", [("2024-01", 1.0, 2.0), ("2024-02", 2.0, 1.0)], "line"),
        ("customer string, revenue double", [("x", 1.0), ("y", 2.0)], "bar"),
        ("weight double, price double", [(1.5, 2.0), (2.0, 3.0)], "scatter"),
        ("rating double, cnt long", [(1.0, 2), (2.0, 3)], "bar"),
        ("store_id string, revenue double", [("x", 1.0), ("y", 2.0)], None),
        ("month string, total double", [("2024-01", 1.0)], None),
        ("customer string, revenue double", [("x", 1.0), (" ", 2.0)], None),
        ("customer string, revenue double", [("x", None), ("y", 2.0)], None),
        ("a string, b string", [("x", "1"), ("y", "2")], None),
        ("a string, b double, c double, d double, e double", [("x", 1.0, 1.0, 1.0, 1.0)] * 2, None),
    ],
)
def test_auto_chart(spark, schema, rows, kind):
    chart = charts.auto_chart(frame(spark, rows, schema))
    assert (chart and chart.kind) == kind


def test_many_bars_become_other(spark):
    many = spark.range(1, 41).selectExpr("concat('c', id) AS cat", "CAST(id AS DOUBLE) AS total")
    chart = charts.auto_chart(many)
    found = {r.label: r.total for r in chart.rows.collect()}
    assert chart.bucketed and len(found) == 24 and found["Other"] == sum(range(1, 18))
    assert charts.auto_chart(many.withColumn("n", F.lit(1))) is None


def test_directed_chart(spark):
    df = frame(spark, [("a", 1.0, 2), ("b", 3.0, 4), ("c", None, 5)], "l string, v double, n int")
    assert [r.label for r in charts.directed_chart(df, "bar", "l", ["v"], "desc").rows.collect()] == ["b", "a", "c"]
    for asked in (("none", "l", ["v"]), ("pie", "l", ["v"]), ("bar", "l", ["x"]), ("bar", "v", ["l"]), ("band", "l", ["v"]), ("bar", "l", [])):
        assert charts.directed_chart(df, *asked) is None
    assert charts.directed_chart(spark.range(25).selectExpr("string(id) AS l", "id AS v"), "bar", "l", ["v"]) is None
    line = frame(spark, [(datetime.date(2024, k, 1), 100.0 * k) for k in range(1, 6)], "d date, amount double")
    assert charts.recipe_chart("forecast", recipes.forecast(line, "d", "amount")).kind == "band"


def test_tiles_ticks_and_numbers(spark):
    assert charts.stat_tile(frame(spark, [("all", 3.0)], "w string, v double")) == ("all", 3.0)
    assert charts.stat_tile(frame(spark, [(3,)], "v long")) == ("v", 3.0)
    assert charts.stat_tile(frame(spark, [(1, 2)], "a int, b int")) is None and charts.stat_tile(spark.range(2)) is None
    assert charts.stat_delta(100.0, 150.0) == (50.0, 50.0) and charts.stat_delta(0.0, 1.0) == (1.0, None) and charts.stat_delta(None, 1.0) is None
    assert charts.nice_ticks(0, 100) == [0, 20, 40, 60, 80, 100] and charts.nice_ticks(0.3, 1.1)[0] <= 0.3 and charts.nice_ticks(5, 5) == [5]
    shown = frame(spark, [(1234.0,), (-1500000.0,), (12.5,), (7.0,), (2e9,)], "v double").select(fx.compact_number(F.col("v")).alias("t")).collect()
    assert [r.t for r in shown] == ["1.2k", "-1.5M", "12.5", "7", "2B"]
    assert tuple(charts.refinements(frame(spark, [("2024-01", 1), ("x", 2)], "l string, v int")).first()) == (False, False, True)
    assert charts.profile_chart({"a": frame(spark, [("x", 1), ("y", 2)], "k string, v int"), "b": spark.range(1)}).rows.count() == 2


def test_guard_scopes_and_functions(spark):
    own = spark.newSession()
    for name in ("t_pub", "t_secret"):
        own.createDataFrame([(1,)], "v int").createOrReplaceTempView(name)
    own.udf.register("evil", lambda x: x, "int")
    own.udf.register("upper", lambda x: x, "string")
    for sql in ("SELECT * FROM t_secret WHERE v IN (WITH t_secret AS (SELECT 1 AS v) SELECT v FROM t_secret)", "SELECT evil(v) FROM t_pub", "SELECT upper('a') FROM t_pub", "SELECT v FROM t_pub LATERAL VIEW evil(v) x AS y", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS v) SELECT * FROM a"):
        with pytest.raises(Refused):
            guard(own, sql, ["t_pub"])
    guard(own, "WITH a AS (SELECT v FROM t_pub), b AS (SELECT v FROM a) SELECT lower('x'), x FROM b LATERAL VIEW explode(array(v)) e AS x WHERE v IN (SELECT v FROM a)", ["t_pub"])


def test_cards(spark):
    df = frame(spark, [("north", "$1,200", "2024-01", 3), ("south", "$300", "2024-02", 4), (None, "x", None, 5)], "region string, amount string, month string, n int")
    assert [tuple(r) for r in cards.column_catalog({"t": df.where("n < 5")}).collect()] == [("t", "region", "text"), ("t", "amount", "numeric"), ("t", "month", "date"), ("t", "n", "numeric")]
    assert cards.schema_card("t", df).splitlines()[:2] == ["t (3 rows)", "region STRING, amount STRING, month STRING, n INT"]
    assert cards.pruned_columns(df.columns, "sum of n by month") == ["region", "amount", "month"]
    assert {r.column_name: (r.n, r.total) for r in cards.fact_sheet(df.where("n < 5")).collect()} == {"amount": (2, 1500.0), "n": (2, 7.0)}
    assert cards.mentions("select * from Orders", "orders") and not cards.mentions("select * from orders_2", "orders")
    assert cards.age(30) == "just now" and cards.age(7200) == "2 hours ago" and cards.age(3 * 86_400) == "3 days ago"
    df.createOrReplaceTempView("t_card")
    assert cards.freshness(spark, "SELECT * FROM t_card", {"t_card": [0.0, 3600.0]}, 7200.0) == "Based on t_card (2 files, newest saved 1 hour ago)."
    assert cards.row_cap_notes({"a": (10, 20), "b": (5, 5)}) == ["a: the first 10 of 20 rows were read."]
    assert cards.extract_sql("Here:\n```sql\nSELECT 1;\n```") == "SELECT 1" == cards.extract_sql("Well, SELECT 1 ;") and cards.extract_sql("none") is None
    assert cards.last_statement(["```sql\nSELECT  1\n```", "no"]) == "SELECT 1" and cards.last_statement([]) is None
    assert cards.answerable("sales per region?", ["region"]) and not cards.answerable("weather", ["region"])
    asked = frame(spark, [("How many per region?",), ("What is it",), ("why did the total fall",)], "q string").select(cards.has_cue(F.col("q")).alias("a"), cards.asks_steps(F.col("q")).alias("b")).collect()
    assert [tuple(r) for r in asked] == [(True, False), (False, False), (True, True)]


@pytest.mark.parametrize("sql", ["select a, b from t_card where a = 'from  x' and b in (select c from t_card) group by a, b order by 1 limit 3", "SELECT " + ", ".join(f"column_number_{k}" for k in range(20)) + " FROM t_card -- note\nWHERE x = 1", "with x as (select 1 as a) select * from x left join y on x.a = y.a"])
def test_format_sql_changes_white_space_only(spark, sql):
    shown = cards.format_sql(sql)
    plan = lambda s: re.sub(r"#\d+", "", parse(spark, s).toString())
    assert plan(shown) == plan(sql) and max(map(len, shown.splitlines())) < 120 and "\n" in shown


def test_index_against_a_plain_search(spark, tmp_path):
    import math
    from collections import Counter

    texts = ["red apples and green apples", "green tea", "the red car", "", "blue sea blue sky"]
    docs = frame(spark, list(enumerate(texts)), "k int, text string")
    index = retrieval.build_index(docs, ["k"], "text", str(tmp_path / "i"))
    words = [[w for w in t.split() if w not in fx.STOP_WORDS] for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    idf = lambda w: math.log(6 / (df[w] + 1)) + 1
    query = ["red", "apples", "zebra"]
    expected = {}
    for k, ws in enumerate(words):
        tf = Counter(ws)
        dot = sum(tf[q] * idf(q) ** 2 for q in query)
        if dot:
            expected[k] = dot / math.sqrt(sum((n * idf(w)) ** 2 for w, n in tf.items())) / math.sqrt(sum(idf(q) ** 2 for q in query))
    found = {r.k: r.score for r in index.search(query).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 1e-9 for k, v in expected.items())
    assert index.search(["zebra"]).isEmpty()


def test_names_pins_and_references(spark):
    names = frame(spark, [(1, "Budgets 2024.xlsx", False), (2, "recipes.md", False), (3, "chat about budget.md", True)], "f int, name string, note boolean")
    hits = frame(spark, [(1, 0.5), (2, 0.1)], "f int, score double")
    found = {r.f: r.score for r in retrieval.boosted(hits, names, "f", ["budget", "plan"], notes="note").collect()}
    assert found == {1: 0.6, 2: 0.1, 3: round((0.5 + 0.4 / 2) * 1.5, 6)}
    assert [r.f for r in retrieval.named_file(names, "f", ["recipe", "list"]).collect()] == [2]
    assert [r.f for r in retrieval.named_file(names, "f", ["budget", "2024"]).collect()] == [1]
    twins = frame(spark, [(1, "budget plan.md"), (2, "budget plan.txt")], "f int, name string")
    assert retrieval.named_file(twins, "f", ["budget", "plan"]).isEmpty()
    parts = frame(spark, [(1, 0, "a" * 300, 0.4), (1, 1, "b", 0.8), (2, 0, "c", 0.2)], "f int, ordinal int, chunk string, score double")
    assert sorted(tuple(r) for r in retrieval.references(parts, "f", "chunk").collect()) == [(1, 1, "b", 1.0), (2, 0, "c", 0.25)]
    assert [tuple(r) for r in retrieval.ranked_documents(parts, "f", 5).collect()] == [(1, 1.0), (2, round(0.2 / 1.2, 6))]
    assert [tuple(r) for r in retrieval.dominant(parts, "f", 2).collect()] == [(1, 2)] and retrieval.dominant(parts, "f", 1).isEmpty()


def test_chunks_segments_and_digests(spark):
    lines = "\n".join(["h1,h2", *[f"{k},x" for k in range(56)]])
    cut = retrieval.tabular_chunks(frame(spark, [(1, lines + "\n\n" + "a\nb")], "k int, text string"), "k").orderBy("block", "ordinal").collect()
    assert [(r.block, r.ordinal, r.rows, r.chunk.split("\n")[0]) for r in cut] == [(0, 0, 30, "h1,h2"), (0, 1, 30, "h1,h2"), (0, 2, 6, "h1,h2"), (1, 0, 1, "a")]
    sizes = frame(spark, [(1, k, s) for k, s in enumerate([40, 50, 20, 200, 5])], "k int, ordinal int, n int")
    assert [r.segment for r in retrieval.segments(sizes, "k", "n", 100).orderBy("ordinal").collect()] == [0, 0, 1, 2, 3]
    text = "Dr. Smith met J. Doe at 5 p.m. on 3. May. He said no! Was it 3.14? \"Yes\" he said."
    found = frame(spark, [(text,)], "t string").select(retrieval.sentences(F.col("t")).alias("s"), retrieval.digest_text(F.col("t"), ["smith", "yes"], 90).alias("d")).first()
    assert found.s == ["Dr. Smith met J. Doe at 5 p.m. on 3. May.", "He said no!", "Was it 3.14?", '"Yes" he said.']
    assert found.d.startswith("Dr. Smith") and found.d.endswith("he said.") and len(found.d) <= 90


def test_semantic_layer(spark):
    frame(spark, [("north", 1.0)], "region string, amount double").createOrReplaceTempView("t_sem")
    catalog = Catalog(spark, ["t_sem"], local_only={"t_sem"})
    catalog.create_view("sem_a", "SELECT region FROM t_sem")
    catalog.create_view("sem_b", "SELECT * FROM sem_a")
    with pytest.raises(Refused):
        catalog.rename_view("sem_a", "sem_c")
    assert catalog.rename_view("sem_b", "Sem C").name == "sem_c" and spark.table("sem_c").count() == 1
    assert catalog.resolve(["t_sem"]) == ["sem_a", "sem_c"] and catalog.resolve(["other"]) == []
    catalog.create_metric("revenue", "sum(amount)", "t_sem")
    assert catalog.private("sem_c") and catalog.private("revenue") and not catalog.private("other")
    catalog.create_synonym("Takings", "revenue")
    with pytest.raises(Refused):
        catalog.create_synonym("takings", "x")
    with pytest.raises(Refused):
        catalog.delete_metric("revenue")
    assert catalog.definitions() == ["revenue = sum(amount) over t_sem", "takings means revenue"] and catalog.definitions("what of takings") == ["takings means revenue"]
    catalog.rename_metric("revenue", "income")
    assert catalog.synonyms == {"takings": "income"} and catalog.delete_metric("income", cascade=True) == ["takings"] and not catalog.synonyms
    edges = frame(spark, [("b", "a"), ("c", "b"), ("d", "x")], "name string, reads string")
    assert sorted(r.name for r in closure(edges, frame(spark, [("a",)], "name string")).collect()) == ["a", "b", "c"]
    assert propose_synonyms(frame(spark, [("amt",)], "column_name string"), frame(spark, [], "term string")).collect()[0].term == "amount"


def test_stores(spark):
    pins = stores.admit(frame(spark, [("me", f"t{k}", "SELECT 1", k) for k in range(25)], "owner string, title string, statement string, created long"))
    assert pins.count() == 20 and all(len(r.pin) == 16 for r in pins.select("pin").distinct().collect())
    now = frame(spark, [("a", 1, None), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x"), ("e", 2, "x")], "pin string, created long, digest string")
    runs = frame(spark, [("a", 1, "n", False), ("b", 1, "x", False), ("c", 1, "y", False), ("d", 1, None, True), ("e", 1, "y", False)], "pin string, created long, digest string, failed boolean")
    assert {r.pin: (r.state, r.digest) for r in stores.rechecked(now, runs).collect()} == {"a": ("primed", "n"), "b": ("same", "x"), "c": ("changed", "y"), "d": ("stale", "x"), "e": ("unchecked", "x")}
    cards_ = frame(spark, [("b", 0, "a"), ("b", 1, "z")], "board string, position int, pin string")
    assert sorted((r.position, r.gone) for r in stores.board_cards(cards_, frame(spark, [("a", "T")], "pin string, title string")).collect()) == [(0, False), (1, True)]
    files_ = frame(spark, [("f1", 1), ("f2", 2)], "id string, modified long")
    assert stores.candidate_digest(files_).first() == stores.candidate_digest(files_.orderBy(F.desc("id"))).first()
    keys = frame(spark, [("What now?",), ("what  now",)], "q string").select(stores.answer_key(F.col("q"), F.lit("d")).alias("k")).distinct()
    assert keys.count() == 1
    log = stores.appended(frame(spark, [], "seq long, payload string, before string, link string"), [{"a": 1}, {"b": 2}], "key")
    log = stores.appended(log, [{"c": 3}], "key")
    assert tuple(stores.verified(log, "key").first()) == (3, None) and stores.verified(log, "other").first().broken == 1
    forged = log.withColumn("payload", F.when(F.col("seq") == 2, "{}").otherwise(F.col("payload")))
    assert stores.verified(forged, "key").first().broken == 2 and stores.verified(log.where("seq <> 2"), "key").first().broken == 3


def test_rules(spark):
    many = frame(spark, [(f"/a{k}/", f"^/a{k}/.*$", "exclude", k) for k in range(12_000)], "scope string, pattern string, verdict string, position int")
    paths = frame(spark, [(1, "/a5/x"), (1, "/a5/x"), (2, "/b"), (3, None)], "k int, path string")
    assert sorted(tuple(r) for r in rules.decide(paths, many, "k", "path").collect()) == [(1, False), (1, False), (2, True), (3, True)]
    found = rules.with_column(frame(spark, [("a", "key"), ("b", "keys")], "table_name string, column_name string"), "KEY")
    assert [tuple(r) for r in found.collect()] == [("a", "key")]


def _workbook(path, rows, shared=()):
    cell = lambda k, v: f'<c r="{chr(65 + k)}1" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}1" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{chr(65 + k)}1"><v>{v}</v></c>'
    data = "".join("<row>" + "".join(cell(k, v) for k, v in enumerate(r) if v is not None) + "</row>" for r in rows)
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {space}><sheetData>{data}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["Staff of the town"], ["Name", "Order Date", "Salary", "Fit"], ["ann", 45658, 45000, True], ["bob", 45689.0, 52000.5, False], [None, 45690, None, True]])
    (tmp_path / "broken.xlsx").write_text("no zip")
    _workbook(tmp_path / "small.xlsx", [["a", "b"], ["1", "2"]])
    found = workbooks.workbook_tables(spark, *[str(tmp_path / n) for n in ("a.xlsx", "broken.xlsx", "small.xlsx")])
    ((_, (table, capped)),) = found.items()
    assert capped is None and table.columns == ["row", "name", "order_date", "salary", "fit"]
    assert [tuple(r)[1:] for r in table.orderBy("row").collect()] == [("ann", "2025-01-01", 45000.0, "TRUE"), ("bob", "2025-02-01", 52000.5, "FALSE"), ("", "2025-02-02", None, "TRUE")]
    assert {r.name: r.extension for r in workbooks.files_in(spark, str(tmp_path)).collect()} == {"a.xlsx": ".xlsx", "broken.xlsx": ".xlsx", "small.xlsx": ".xlsx"}
    assert workbooks.iso_of(45658.5) == "2025-01-01 12:00:00" and workbooks.iso_of(-1) == "-1" and workbooks.iso_of(0, True) == "1904-01-01"


def test_recipes_of_odd_tables(spark):
    df = frame(spark, [("a", 1), ("b", 2)], "k string, v int")
    assert recipes.insights({"t": df}).isEmpty() and recipes.insights({}).isEmpty()
    assert {r.column_name: r.q1 for r in recipes.run_recipe(df, "data-quality-audit").collect()} == {"k": None, "v": 1.0}


def test_registered_csv_has_its_own_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    files.register(spark, [str(tmp_path / "t.csv")])
    assert run_query(spark, "SELECT a + b AS s FROM t", ["t"], seconds=60).rows == [(3,)]


def test_artifacts(spark, tmp_path):
    df = frame(spark, [("a", 1.5), (None, 2.0)], "k string, v double")
    paths = [p.rsplit("/", 1)[1] for p in (execute.save_csv(df, str(tmp_path), "out.csv") for _ in range(2))]
    assert paths == ["out.csv", "out-2.csv"] and (tmp_path / "out.csv").read_bytes().startswith(b"k,v\r\n")
    df.createOrReplaceTempView("t_art")
    found = run_query(spark, "SELECT * FROM t_art ORDER BY v", ["t_art"], seconds=60)
    assert execute.to_csv(found, "\n") == "k,v\na,1.5\n,2.0\n" and execute.to_json(found) == '{"columns": ["k", "v"], "rows": [["a", "1.5"], ["", "2.0"]]}'


def test_ledger_tells_dates_and_rows(spark):
    frame(spark, [(datetime.date(2024, 1, 1), 1.0)], "d date, v double").createOrReplaceTempView("t_led")
    found = ledger(spark, "SELECT date_format(d, 'yyyy-MM') AS m, sum(v) AS s FROM t_led WHERE v > 0 GROUP BY date_format(d, 'yyyy-MM')", 12)
    assert found[0] == "Dates are taken from d" and found[-2:] == ["12 rows considered", "Reads t_led"] and len(found) == 6


def test_hybrid_needs_vectors(spark):
    lexical = frame(spark, [(1, 0.9), (2, 0.5)], "k int, score double")
    vectors = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, embedding array<double>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert {r.k: r.score for r in retrieval.hybrid(lexical, vectors, query, lexical, "k").collect()}[1] == 1.0
    assert {r.k: r.score for r in retrieval.hybrid(lexical, vectors.where("k = 1"), query, lexical, "k").collect()} == {1: 0.9, 2: 0.5}


def test_local_files_stay(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("x,y\n1,2\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert [r.table for r in files.register(spark, paths, local_only={paths[0]}, cloud=True)] == ["b"]
    assert len(files.register(spark, paths, local_only={paths[0]})) == 2


def test_retrieve(spark, tmp_path):
    texts = {1: "budget of the town for next year", 2: "a recipe for soup " * 40, 3: "minutes of the meeting on the budget", 4: "nothing here"}
    parts = retrieval.chunks(frame(spark, list(texts.items()), "f int, text string"), "f")
    index = retrieval.build_index(parts, ["f", "ordinal"], "chunk", str(tmp_path / "i"))
    names = frame(spark, [(1, "plan.md"), (2, "soup recipes.md"), (3, "notes.md"), (4, "budget 2024.md")], "f int, name string")
    found = retrieval.retrieve(index, parts, names, "f", ["budget", "town"]).collect()
    assert [r.f for r in found][0] == 4 and {r.f for r in found} == {1, 3, 4} and found[0].pin == 1 and found[0].snippet == "nothing here"
    assert [r.f for r in retrieval.retrieve(index, parts, names, "f", ["soup", "recipe"], 1).collect()] == [2]
