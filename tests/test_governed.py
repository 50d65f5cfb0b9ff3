"""Trees of statements, certification and reconciliation, closure, mining, QUALIFY, CSV, logs and boards."""

import csv
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from veritab.operators import stores
from veritab.operators.rules import evenly_spaced
from veritab.operators.semantic import Catalog, closure, mine_metrics, propose_metric
from veritab.plans.execute import save_csv
from veritab.plans.guard import Refused, guard, parser
from veritab.plans.qualify import rewritten
from veritab.plans.trees import canonical
from veritab.plans.wholes import whole_digest
from veritab.sources.files import read_file
from veritab.streaming.watch import recheck

PAID = "sum(amount) FILTER (WHERE status = 'paid')"


@pytest.fixture(scope="module")
def catalog(spark):
    spark.createDataFrame([("north", 10.0, "paid"), ("south", 20.0, "paid"), ("south", 7.0, "paid"), ("north", 5.0, "void")], "region string, amount double, status string").createOrReplaceTempView("g_sales")
    spark.createDataFrame([("north", 1), ("south", 2), ("south", 3)], "region string, k int").createOrReplaceTempView("g_regions")
    c = Catalog(spark, ["g_sales", "g_regions"])
    c.create_metric("revenue", "SUM(amount) FILTER (WHERE status='paid')", "g_sales")
    return c


@pytest.mark.parametrize(
    "sql",
    [
        f"SELECT {PAID} AS revenue FROM g_sales",
        f"SELECT {PAID} FROM g_sales",
        f"SELECT region AS r, {PAID} v FROM g_sales GROUP BY r",
        f"SELECT region, {PAID} FROM g_sales GROUP BY 1 ORDER BY 2 LIMIT 1",
        f"SELECT upper(region), {PAID} x FROM g_sales GROUP BY upper(region) HAVING {PAID} > 12",
        f"SELECT {PAID} FROM g_sales WHERE region IN (SELECT region FROM g_regions WHERE k = 1)",
        f"SELECT s.region, {PAID} FROM g_sales s JOIN g_regions r ON s.region = r.region GROUP BY s.region",
        f"WITH t AS (SELECT k FROM g_regions) SELECT {PAID} AS a FROM g_sales",
    ],
)
def test_the_metric_computed_anew_agrees(catalog, sql):
    assert catalog.certified(sql) == ["revenue"]
    verdict = catalog.reconcile(sql, "revenue")
    assert verdict.reconciled and verdict.expected == verdict.got and verdict.metric == "revenue"


def test_other_figures_no_figures_and_refused_statements(spark, catalog):
    sql = f"SELECT {PAID} AS revenue FROM g_sales"
    told = catalog.reconcile(sql, "revenue", spark.sql("SELECT sum(amount) AS revenue FROM g_sales"))
    assert told.certified and not told.reconciled and told.expected != told.got
    assert not catalog.reconcile(f"SELECT {PAID} FROM g_sales WHERE amount > 99 GROUP BY region", "revenue").reconciled
    assert catalog.reconcile("SELECT sum(amount) AS revenue FROM g_sales", "revenue").certified is False
    assert catalog.certified("SELECT sum(") == [] and catalog.certified("SELECT sum(amount) FROM g_sales") == []
    with pytest.raises(Refused):
        catalog.reconcile("DROP VIEW g_sales", "revenue")
    assert spark.catalog.tableExists("g_sales")
    assert propose_metric(spark, "SELECT sum(amount) FROM g_sales") == ("sum(amount)", "g_sales")
    assert propose_metric(spark, "SELECT region FROM g_sales GROUP BY region") is None
    assert propose_metric(spark, "SELECT sum(a) FROM x JOIN y ON x.k = y.k") is None
    for bad in ("SELECT current_user()", "SELECT input_file_block_start()", "SELECT session_user()"):
        with pytest.raises(Refused):
            guard(spark, bad, [])
    assert recheck(spark, {"p": ("SELECT k FROM g_regions", None), "q": ("SELECT k FROM g_regions", None)}, ["g_sales"])["p"][0] == "stale"
    assert recheck(spark, {"p": ("SELECT k FROM g_regions", None)}, ["g_regions"])["p"][0] == "new"


def test_trees_fold_spelling_and_order(spark):
    tree = lambda x, c=True: canonical(parser(spark).parseExpression(x), c)
    assert tree("SUM(a * (b + c))") == tree("sum( (t.C+B) * A )") != tree("sum(a * b + c)")
    assert tree("a > 1 AND b = 2") == tree("2 = b and 1 < a") and tree("a - b") != tree("b - a")
    assert tree("count(DISTINCT a)") != tree("count(a)") and tree("'x'") != tree("'X'") and tree("1") != tree("1.0")
    assert tree("a * b", False) != tree("b * a", False)


def test_statements_count_by_their_trees(spark, catalog):
    said = [("SELECT sum(a*b) AS x FROM t WHERE k = 1", False), ("select SUM( b * a )  from T where k = 2", False), ("SELECT sum(c) FROM t", False), ("SELECT avg(c) FROM t", True), ("nonsense", False), (None, None), ("SELECT sum(c) FROM t JOIN u ON t.a = u.a", False), (f"SELECT {PAID} FROM g_sales", True), ("SELECT max(c) FROM t WHERE n = 'a b'", None), ("SELECT max(c) FROM t WHERE n = 'it''s'", None)]
    got = {(r.expression, r.entity): (r.n, r.certified) for r in mine_metrics(spark.createDataFrame(said, "statement string, certified boolean"), catalog).collect()}
    assert got == {("SUM((b * a))", "t"): (2, False), ("avg(c)", "t"): (1, True), ("max(c)", "t"): (2, False)}
    with pytest.raises(Refused):
        mine_metrics(spark.createDataFrame(said, "statement string, certified boolean"), catalog, shapes=2)


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(50)] + [("x", "y"), ("y", "x"), ("x", "n50"), ("z", "w"), (None, "n1"), ("v", None)]
    got = closure(spark.createDataFrame(edges, "name string, reads string"), spark.createDataFrame([("n0",), (None,)], "name string"))
    assert sorted(r.name for r in got.collect()) == sorted([f"n{i}" for i in range(51)] + ["x", "y"])


QUALIFIED = [
    "SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS rn FROM t QUALIFY rn <= 2 ORDER BY k, rn",
    "SELECT k FROM t QUALIFY sum(v) OVER (PARTITION BY k) > 6 AND v > 1 ORDER BY v DESC, k LIMIT 3",
    "SELECT * FROM (SELECT k, v FROM t QUALIFY max(v) OVER () = v) q QUALIFY count(*) OVER () >= 1",
    "SELECT k, sum(v) s FROM t GROUP BY k HAVING count(*) > 1 QUALIFY rank() OVER (ORDER BY s DESC) = 1",
    "WITH a AS (SELECT k, v FROM t QUALIFY lag(v) OVER w IS NULL) SELECT k, v FROM a WHERE v IN (SELECT v FROM t QUALIFY ntile(2) OVER (ORDER BY v, k) = 1)".replace("FROM t QUALIFY lag", "FROM t WINDOW w AS (PARTITION BY k ORDER BY v) QUALIFY lag"),
    "SELECT DISTINCT k AS \"qualify_k\" FROM t QUALIFY count(*) OVER (PARTITION BY \"qualify_k\") > 1 UNION ALL SELECT 'QUALIFY' FROM t QUALIFY row_number() OVER (ORDER BY v, k) = 1".replace('"', ""),
    "SELECT k, CASE WHEN v > 2 THEN 'a' ELSE 'b' END FROM t /* QUALIFY x */ QUALIFY dense_rank() OVER (ORDER BY v) = 2 -- QUALIFY no",
]


@pytest.mark.parametrize("sql", QUALIFIED)
def test_qualify_is_what_duckdb_makes_of_it(spark, sql):
    rows = [("a", 1), ("a", 2), ("a", 4), ("b", 2), ("b", 5), ("c", 3)]
    spark.createDataFrame(rows, "k string, v int").createOrReplaceTempView("t")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR, v INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    new = rewritten(sql)
    guard(spark, new, ["t"])
    assert sorted(map(str, (tuple(r) for r in spark.sql(new).collect()))) == sorted(map(str, con.execute(sql).fetchall()))
    assert rewritten("SELECT qualify, t.qualify FROM t") == "SELECT qualify, t.qualify FROM t"


def test_csv_keeps_every_cell(spark, tmp_path):
    rows = [(1, 'Smith, "Al", Jr', 'say "hi", ok', 1.5), (2, "two\nlines\r\nx", "C:\\path\\", None), (3, "x", '\\"', 2.0), (4, None, " lead ", -12.25), (5, ",", '"', 0.0)]
    df = spark.createDataFrame(rows, "id int, a string, b string, v double")
    path = save_csv(df.orderBy("id"), str(tmp_path), "out.csv")
    with open(path.removeprefix("file:"), newline="") as f:
        assert list(csv.reader(f))[0] == ["id", "a", "b", "v"]
    with open(path.removeprefix("file:"), newline="") as f:
        assert [r[1] for r in csv.reader(f)][1:] == [r[1] or "" for r in rows]
    assert sorted(map(tuple, read_file(spark, path).collect())) == rows
    (tmp_path / "plain.csv").write_text('name,said,n\n"Smith, ""Al"", Jr","say ""hi"", ok",1\nb,"x",-2\n')
    plain = read_file(spark, str(tmp_path / "plain.csv"))
    assert plain.dtypes[2] == ("n", "int") and plain.first()[0] == 'Smith, "Al", Jr'
    (tmp_path / "t.tsv").write_text('a\tb\n"x\ty"\t"l1\nl2"\n')
    assert tuple(read_file(spark, str(tmp_path / "t.tsv")).first()) == ("x\ty", "l1\nl2")


def test_logs_tell_of_changed_repeated_and_missing_records(spark):
    rows = spark.createDataFrame([(g, i, f"p{i}") for g in "ab" for i in range(6)], "g string, at int, payload string")
    log = stores.chained(rows, ["g"], "key" * 40)
    own = {(r.g, r.seq): r for r in log.collect()}
    before = stores.GENESIS
    for i in range(1, 7):
        assert own["a", i].link == stores.link("key" * 40, before, f"p{i - 1}") and own["a", i].before == before
        before = own["a", i].link
    check = lambda x: {r.g: (r.records, r.broken) for r in stores.verified(x, "key" * 40, ["g"]).collect()}
    assert check(log) == {"a": (6, None), "b": (6, None)}
    assert check(log.unionAll(log.where("g = 'a'"))) == {"a": (12, 1), "b": (6, None)}
    assert check(log.where("NOT (g = 'b' AND seq = 4)")) == {"a": (6, None), "b": (5, 5)}
    assert check(log.withColumn("payload", F.when(F.expr("g = 'a' AND seq = 3"), "x").otherwise(F.col("payload"))))["a"] == (6, 3)
    assert check(log.withColumn("link", F.when(F.expr("g = 'a' AND seq = 6"), F.lit(None)).otherwise(F.col("link"))))["a"] == (6, 6)
    assert stores.verified(log.limit(0).drop("g"), "k").first() == (0, None)


def test_pins_take_a_new_digest_only_if_they_are_still_the_ones_that_ran(spark, catalog):
    pins = spark.createDataFrame([("p", 1, "T", "SELECT k FROM g_regions", None), ("q", 1, "U", "DROP VIEW g_sales", "d")], "pin string, created int, title string, statement string, digest string")
    runs = stores.refreshed(spark, pins, ["g_regions"], F.lit(1)).cache()
    assert {r.pin: (r.rows, r.failed) for r in runs.collect()} == {"p": (3, False), "q": (None, True)}
    done = {r.pin: r.digest for r in stores.advanced(pins, runs).collect()}
    assert done["q"] == "d" and done["p"] == whole_digest(spark.table("g_regions").select("k").orderBy(F.desc("k")))[1]
    again = stores.advanced(pins.withColumn("created", F.lit(2)), runs)
    assert {r.digest for r in again.collect()} == {None, "d"}
    twice = runs.unionAll(runs.withColumn("at", F.lit(2)).withColumn("digest", F.lit("new")).withColumn("failed", F.lit(False)))
    assert {r.pin: r.digest for r in stores.rechecked(pins, twice).collect()} == {"p": "new", "q": "new"}
    cards = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (1, 3, "gone")], "board int, position int, pin string")
    text = stores.briefing_text("Week", stores.board_refresh(cards, pins, runs))
    assert text == "# Week\n\n0 of 3 changed.\n\n- U: stale\n- gone: gone\n- T: primed"


def test_digests_of_whole_results(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None), (2, None, None)], "k int, s string, v array<double>")
    assert whole_digest(df) == whole_digest(df.orderBy(F.desc("k")).repartition(3)) != whole_digest(df.distinct())
    assert whole_digest(df)[1] != whole_digest(df.withColumn("s", F.coalesce("s", F.lit(""))))[1]
    assert whole_digest(df.select("k", "s"))[1] != whole_digest(df.select("s", "k"))[1]
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('c', 3)"), spark.sql("SELECT map('c', 3) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert whole_digest(maps[0]) == whole_digest(maps[1])


def test_evenly_spaced_of_few(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [[r.k for r in evenly_spaced(df, "k", m).orderBy("k").collect()] for m in (0, 1, 2, 4, 20)] == [[], [0], [0, 9], [0, 3, 6, 9], list(range(10))]


def test_closure_reads_edges_once_a_step(spark):
    edges = spark.createDataFrame([(f"a{random.Random(i).randrange(300)}", f"a{i % 200}") for i in range(2000)], "name string, reads string")
    began = time.time()
    got = {r.name for r in closure(edges, spark.createDataFrame([("a7",)], "name string")).collect()}
    plain, pairs = {"a7"}, [tuple(r) for r in edges.collect()]
    while more := {n for n, r in pairs if r in plain} - plain:
        plain |= more
    assert got == plain and time.time() - began < 120
