"""HTML packs, views at query time, cues, planned tables and number forms."""

import pytest
from pyspark.sql import functions as F

from veritab.functions.text import grouped_number
from veritab.operators.semantic import Catalog
from veritab.plans import cards
from veritab.plans.direct import run_direct
from veritab.plans.guard import Refused
from veritab.plans.packs import Card, bars_svg, board_pack, evidence_pack


def test_packs_hold_all_and_escape_it(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("region,amount\n<b>north,10\nsouth & east,-20\n")
    sql = "SELECT region, sum(amount) AS total FROM sales WHERE region <> '<script>' GROUP BY region ORDER BY region"
    run = run_direct(spark, sql, [str(tmp_path / "sales.csv"), "gone.csv"])
    pack = evidence_pack("Which <region>?", "South & east.\n\nSecond.", sql, run, 0.0)
    assert pack == evidence_pack("Which <region>?", "South & east.\n\nSecond.", sql, run, 0.0)
    for part in ("<h1>Which &lt;region&gt;?</h1>", "Generated 1970-01-01 00:00 UTC", "<p>South &amp; east.</p>\n<p>Second.</p>", '<td>&lt;b&gt;north</td><td class="n">10</td>', "&#x27;&lt;script&gt;&#x27;", "Based on sales (saved", "1 of the files could not be read", "sales.csv — ", "<svg ", run.result.digest):
        assert part in pack, part
    assert "<script" not in pack and "<b>north" not in pack and pack.count("http") == 1
    board = board_pack("Week & more", [Card("Totals", sql, "Based on sales.", run.result, "footer line"), Card("Old", "SELECT 1", "stored 3 days ago", stale="failed <now>")], 0.0)
    assert board.count("<table>") == 1 and "failed &lt;now&gt;" in board and board.index("Queries") > board.index("stored 3 days ago") and "<p>footer line</p>" in board
    assert "This board has no cards." in board_pack("Empty", [], 0.0) and bars_svg([("a", None)]) == ""


def test_views_hold_over_the_tables_of_a_run(spark):
    for name in ("v_open", "v_private"):
        spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").createOrReplaceTempView(name)
    catalog = Catalog(spark, ["v_open", "v_private"], local_only={"v_private"})
    catalog.create_view("doubled", "SELECT k, 2 * n AS n FROM v_open")
    catalog.create_view("quadrupled", "SELECT k, 2 * n AS n FROM doubled")
    catalog.create_view("secret", "SELECT k FROM v_private")
    assert sorted(catalog.run("SELECT n FROM quadrupled", ["v_open"]).rows) == [(4,), (8,)]
    assert catalog.run("SELECT k FROM secret ORDER BY k", ["v_open", "v_private"]).rows == [("a",), ("b",)]
    for sql, tables, cloud in (("SELECT k FROM secret", ["v_open", "v_private"], True), ("SELECT k FROM v_private", ["v_private"], True), ("SELECT n FROM quadrupled", ["v_private"], False)):
        with pytest.raises(Refused):
            catalog.run(sql, tables, cloud)
    with pytest.raises(Refused):
        catalog.run("SELECT n FROM quadrupled", ["v_open"], most=2)
    catalog.views["doubled"].sql = "SELECT nothing FROM v_open"
    with pytest.raises(Refused):
        catalog.run("SELECT n FROM quadrupled", ["v_open"])


def test_cues(spark):
    asked = spark.createDataFrame([("Compare all my files!",), ("what did I  ask, yesterday",), ("incomparable",), ("Total per region",), ("why did it change between the years? average",), (None,)], "q string")
    q = F.col("q")
    got = [tuple(r) for r in asked.select(cards.has_cue(q), cards.asks_steps(q), cards.asks_across(q), cards.asks_recall(q)).collect()]
    assert got == [(False, False, True, False), (False, False, False, True), (False, False, False, False), (True, False, False, False), (True, True, True, False), (False, False, False, False)]


def test_planned_tables_and_synonyms(spark):
    catalog = spark.createDataFrame([("sales", "amt", "numeric"), ("sales", "region", "text"), ("staff", "salary", "numeric"), ("zones", "region_id", "numeric"), ("other", "x", "text")], "table_name string, column_name string, kind string")
    synonyms = spark.createDataFrame([("Turnover", "AMT"), ("wage", "salary")], "term string, column_name string")
    ranked = lambda q, s=None: [tuple(r) for r in cards.planned_tables(catalog, q, s).collect()]
    assert ranked("turnover by region", synonyms) == [("sales", 6), ("zones", 3), ("other", 0)]
    assert ranked("turnover by region") == [("sales", 3), ("zones", 3), ("other", 0)]
    assert ranked("staff?") == [("staff", 2), ("other", 0), ("sales", 0)] and ranked("")[0] == ("other", 0)


def test_grouped_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (1234567.891, -1200.5, 0.0, 12.0, -0.001, 999.999, None)], "v double")
    assert [r[0] for r in df.select(grouped_number(F.col("v"))).collect()] == ["1,234,567.89", "-1,200.5", "0", "12", "0", "1,000", None]
