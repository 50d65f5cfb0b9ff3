from pyspark.sql import functions as F

from veritab.functions import text as fx
from veritab.operators import retrieval, rules
from veritab.sources import files
from veritab.streaming.watch import recheck, watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_families_unite_and_hint(spark, tmp_path):
    for k in range(1, 13):
        (tmp_path / f"sales-2025-{k:02}.csv").write_text(f"Region Name,Amount\nnorth,{k}\nsouth,{k}\n")
    (tmp_path / "regions.csv").write_text("Region Name,Label\nnorth,N\nsouth,S\n")
    (tmp_path / "broken.txt").write_text("x")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    found = files.register(spark, paths)
    assert [(r.table, len(r.files)) for r in found] == [("sales_all", 12), ("regions", 1)]
    assert spark.sql("SELECT sum(amount) AS s FROM sales_all").first().s == 156
    assert files.join_hints(found) == ["sales_all.region_name = regions.region_name"]
    assert files.uncovered(paths, found) == 1


def test_header_row():
    assert files.header_row([["Report", "", ""], ["", "", ""], ["a", "b", "c"], ["1", "2", "3"]]) == 2
    assert files.header_row([["1", "2"], ["a", "b"]]) == 1
    assert files.header_row([["1", "2"], ["3", "4"]]) == 0 and files.header_row([]) == 0


def test_numbers(spark):
    for text, value in (("$1,200.50", 1200.5), ("(300)", -300.0), ("12%", 12.0), ("x", None), ("NaN", None)):
        assert one(spark, fx.number(F.lit(text))) == value


def test_small_text_functions(spark):
    assert fx.sanitize("2024 Sales (Q1)") == "t_2024_sales_q1" == one(spark, fx.sanitized(F.lit("2024 Sales (Q1)")))
    assert one(spark, fx.year(F.lit("3/4/2017"))) == 2017 and one(spark, fx.year(F.lit("2016-01-02"))) == 2016
    assert one(spark, fx.looks_temporal(F.lit("2024-05"))) and not one(spark, fx.looks_temporal(F.lit("9999")))
    assert one(spark, fx.question_key(F.lit("  What   now?! "))) == "what now"
    assert one(spark, fx.unverified_numbers(F.lit("12 of 1,300 [3]"), F.lit("1300.5"))) == ["12"]
    assert one(spark, F.lit("a/b/c.csv").rlike(fx.glob_pattern("a/**/*.csv"))) and not one(spark, F.lit("a/b/c.csv").rlike(fx.glob_pattern("a/*.csv")))


def test_chunk_counts(spark):
    for n in (0, 1, 120, 121, 215, 216, 500):
        df = spark.createDataFrame([(1, " ".join(["w"] * n))], "k long, text string")
        assert retrieval.chunks(df, "k").count() == (0 if n == 0 else 1 if n <= 120 else -(-(n - 120) // 95) + 1)


def test_fusion_of_two_firsts_is_one(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.1)], "k long, score double")
    assert retrieval.fuse(a, a, "k").orderBy(F.desc("score")).first().score == 1.0


def test_top_and_other(spark):
    df = spark.range(1, 41).selectExpr("CAST(id AS STRING) AS l", "CAST(id AS DOUBLE) AS v")
    found = {r.label: r.value for r in rules.top_and_other(df, "l", "v").collect()}
    assert len(found) == 24 and found["Other"] == sum(range(1, 18))


def test_pins_and_stream(spark, tmp_path):
    data, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("P1", 3)], "p string, n int").write.parquet(data)
    schema = spark.read.parquet(data).schema
    for _ in range(2):
        watch(spark, data, schema, str(tmp_path / "ck"), lambda rows, batch: seen.append(rows.count())).awaitTermination(60)
    assert seen == [1]
    spark.read.parquet(data).createOrReplaceTempView("t_pin")
    state, first = recheck(spark, {"a": ("SELECT * FROM t_pin", None)}, ["t_pin"])["a"]
    assert state == "new" and recheck(spark, {"a": ("SELECT * FROM t_pin", first), "b": ("SELECT * FROM gone", "x")}, ["t_pin"]) == {"a": ("same", first), "b": ("stale", "x")}
