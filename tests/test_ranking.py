"""Type-ahead, quick-open and the share test on small tables."""

from veritab.operators import ranking as m


def test_past_questions(spark):
    now = 10 * m.HALF_LIFE_MS
    history = spark.createDataFrame([("Total sales", now, 1), ("total  SALES", now - m.HALF_LIFE_MS, 8), ("other total", now - m.HALF_LIFE_MS, 1), (" ", now, 1), (None, now, 1), ("t.o", now, 1)], "text string, ts long, count int")
    pins = spark.createDataFrame([("Total cost",), ("TOTAL SALES",)], "text string")
    found = m.past_questions(history, pins, " tot ", now).collect()
    assert [(r.text, r.source, round(r.score, 3)) for r in found] == [("Total sales", "pin", 1160.0), ("Total cost", "pin", 1120.0), ("other total", "history", 57.5)]
    assert m.past_questions(history, pins, "  ", now).isEmpty()


def test_quick_open(spark):
    rows = [(1, "budget.md", "a/budget.md", "file"), (2, "my budget", "my budget", "file"), (3, "x", "budget/x", "file"), (4, "budget", "budget", "folder"), (5, "Budget.md", "Budget.md", None), (6, "b.d", "b.d", "file"), (7, None, None, "file")]
    found = m.quick_open(spark.createDataFrame(rows, "id long, name string, path string, kind string"), "bud")
    assert [(r.id, r.score) for r in found.collect()] == [(5, 2100.0), (1, 2100.0), (2, 1100.0), (3, 100.0)]
    dots = m.quick_open(spark.createDataFrame(rows, "id long, name string, path string, kind string"), "b.d").collect()
    assert dots[0].id == 6 and all("." in r.path for r in dots)


def test_stackable(spark):
    def told(rows):
        return m.stackable(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()[0]

    assert told([(60.0, 40.0), (50.2, 50.0)]) and told([(0.5, 0.5)])
    assert not any(map(told, [[], [(60.0, None)], [(110.0, -10.0)], [(60.0, 40.0), (0.5, 0.5)], [(1.0, 2.0)]]))
    assert not m.stackable(spark.range(1), ["id"]).first()[0]
