import pytest

from veritab.operators.semantic import Catalog, ledger, propose_metric
from veritab.plans.execute import digest, run_query, to_csv, to_markdown
from veritab.plans.guard import Refused, guard, reads


@pytest.fixture(scope="module")
def tables(spark):
    spark.createDataFrame([("north", 10.0, "paid"), ("south", 20.0, "paid"), ("south", 7.0, "paid"), ("north", 5.0, "void")], "region string, amount double, status string").createOrReplaceTempView("t_sales")
    spark.range(250).selectExpr("id", "id AS v").createOrReplaceTempView("t_big")
    return ["t_sales", "t_big"]


@pytest.mark.parametrize("sql", ["INSERT INTO t_sales VALUES (1)", "DROP TABLE t_sales", "SELECT 1; SELECT 2", "SELECT TRANSFORM(region) USING 'cat' FROM t_sales", "SELECT * FROM parquet.`/etc/x`", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM other", "SELECT * FROM range(3)", "SET a = b", "WITH x AS (INSERT INTO t_sales VALUES (1)) SELECT 1", "SELECT region FROM t_sales WHERE EXISTS (SELECT 1 FROM other)", "CREATE TABLE y AS SELECT 1", "EXPLAIN SELECT 1"])
def test_guard_refuses(spark, tables, sql):
    with pytest.raises(Refused):
        guard(spark, sql, tables)


@pytest.mark.parametrize("sql", ["SELECT region, sum(amount) FROM t_sales GROUP BY region HAVING sum(amount) > 1 ORDER BY 2 LIMIT 3", "WITH a AS (SELECT * FROM t_sales) SELECT a.region FROM a JOIN t_big ON a.amount = t_big.v", "VALUES (1, 'a')", "SELECT region FROM t_sales UNION ALL SELECT 'x'", "SELECT region, row_number() OVER (ORDER BY amount) FROM t_sales", "SELECT region FROM t_sales WHERE amount IN (SELECT v FROM t_big)"])
def test_guard_admits(spark, tables, sql):
    guard(spark, sql, tables)


def test_reads_sees_subqueries_and_not_ctes(spark):
    assert reads(spark, "WITH a AS (SELECT * FROM t_big) SELECT * FROM a WHERE v IN (SELECT amount FROM t_sales)") == ["t_big", "t_sales"]


def test_cap_is_told(spark, tables):
    found = run_query(spark, "SELECT * FROM t_big ORDER BY id", tables, seconds=60)
    assert (len(found.rows), found.truncated, found.total) == (200, True, 250)
    assert found.note == "Showing the first 200 rows of 250."


def test_no_rows_is_an_error(spark, tables):
    with pytest.raises(Refused):
        run_query(spark, "SELECT * FROM t_big WHERE id < 0", tables, seconds=60)


def test_digest_without_order_ignores_row_order():
    assert digest([(1, 2.0), (3, None)], False) == digest([(3, None), (1, 2.0)], False)
    assert digest([(1,), (2,)], True) != digest([(2,), (1,)], True)


def test_outputs(spark, tables):
    found = run_query(spark, "SELECT 'a|b' AS x, CAST(NULL AS INT) AS y", tables, seconds=60)
    assert to_markdown(found).splitlines()[2] == "| a\\|b |  |"
    assert to_csv(found) == "x,y\r\na|b,\r\n"


def test_views(spark, tables):
    catalog = Catalog(spark, tables)
    catalog.create_view("Paid Sales", "SELECT * FROM t_sales WHERE status = 'paid'")
    catalog.create_view("v2", "SELECT * FROM paid_sales")
    catalog.create_view("v3", "SELECT * FROM v2")
    with pytest.raises(Refused):
        catalog.create_view("v4", "SELECT * FROM v3")
    with pytest.raises(Refused):
        catalog.drop_view("paid_sales")
    assert catalog.drop_view("paid_sales", cascade=True) == ["paid_sales", "v2", "v3"]


def test_metrics(spark, tables):
    catalog = Catalog(spark, tables)
    catalog.create_metric("paid", "sum(amount) FILTER (WHERE status = 'paid')", "t_sales")
    good = "SELECT SUM(amount) FILTER (WHERE status = 'paid') AS p FROM t_sales"
    near = "SELECT SUM(amount) AS p FROM t_sales"
    assert catalog.certified(good) == ["paid"] and catalog.certified(near) == []
    assert catalog.reconcile(good, "paid").reconciled and not catalog.reconcile(near, "paid").certified
    with pytest.raises(Refused):
        catalog.create_metric("amount", "sum(amount)", "t_sales")


def test_proposal_and_ledger(spark, tables):
    sql = "SELECT region, sum(amount) AS s FROM t_sales WHERE status = 'paid' GROUP BY region"
    assert propose_metric(spark, sql)[1] == "t_sales"
    assert [x.split()[0] for x in ledger(spark, sql)] == ["Grouped", "Only", "Empty", "Reads"]
