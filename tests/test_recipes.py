"""Hand-computed fixtures of the recipes."""

import datetime

import pytest

from veritab.operators import profile, recipes


def months(spark, totals):
    return spark.createDataFrame([(datetime.date(2024, k + 1, 15), float(v)) for k, v in enumerate(totals)], "d date, amount double")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("2024-02-01", "South", "R01", 40.0), ("2024-02-09", "North", "R02", 60.0), ("2024-03-01", "South", "R03", 200.0), ("2024-03-02", "North", "R04", 100.0), ("2024-03-03", "North", "R05", None), ("2024-01-05", "East", "R05", 5.0)]
    return spark.createDataFrame([(datetime.date.fromisoformat(d), *rest) for d, *rest in rows], "d date, region string, order_id string, amount double")


def test_variance(sales):
    assert tuple(recipes.variance_vs_last_period(sales, "d", "amount").first()) == ("2024-03", 300.0, "2024-02", 100.0, 200.0, 200.0)


def test_top_movers(sales):
    found = [tuple(r) for r in recipes.top_movers(sales, "region", "amount", "d").collect()]
    assert found == [("South", 200.0, 40.0, 160.0, 400.0), ("North", 100.0, 60.0, 40.0, 66.7)]


def test_completeness(sales):
    found = {r.column_name: r for r in recipes.completeness(sales).collect()}
    assert (found["amount"].nulls, found["amount"].null_pct, found["order_id"].duplicates) == (1, 16.7, 1)


def test_completeness_by_sketches(spark):
    df = spark.range(5000).selectExpr("id", "id % 100 AS g")
    found = {r.column_name: r.distinct_values for r in recipes.completeness(df, 0.01).collect()}
    assert abs(found["id"] - 5000) < 250 and abs(found["g"] - 100) <= 5


def test_anomaly_finds_the_one_month(spark):
    found = recipes.anomaly_scan(months(spark, [100] * 9 + [400]), "d", "amount").collect()
    assert [tuple(r) for r in found] == [("2024-10", 400.0, 2.85)]


def test_anomaly_of_a_flat_series_is_none(spark):
    assert recipes.anomaly_scan(months(spark, [300] * 6), "d", "amount").isEmpty()


def test_forecast_line(spark):
    found = [tuple(r) for r in recipes.forecast(months(spark, [100, 200, 300, 400, 500]), "d", "amount").where("kind = 'forecast'").collect()]
    assert found == [(f"2024-0{k}", v, v, v, "forecast") for k, v in ((6, 600.0), (7, 700.0), (8, 800.0))]
    fit = recipes.forecast_fit(months(spark, [100, 200, 300, 400, 500]), "d", "amount").first()
    assert (round(fit.slope, 6), round(fit.intercept, 6), round(fit.sigma, 6), fit.n) == (100, 100, 0, 5)


def test_forecast_needs_three_months(spark):
    assert [r.kind for r in recipes.forecast(months(spark, [1, 2]), "d", "amount").collect()] == ["actual", "actual"]


def test_changepoint(spark):
    assert tuple(recipes.changepoint_scan(months(spark, [100] * 4 + [500] * 4), "d", "amount").first()) == ("2024-04", 100.0, 500.0, 400.0, 1.87)
    assert recipes.changepoint_scan(months(spark, [300] * 4), "d", "amount").first().magnitude == 0
    assert recipes.changepoint_scan(months(spark, [1, 2, 3]), "d", "amount").isEmpty()


def test_recipes_decline_and_resolve(spark, sales):
    assert recipes.run_recipe(spark.createDataFrame([("a",)], "x string"), "forecast") is None
    assert set(recipes.applicable(sales)) == set(recipes.RECIPES)
    assert recipes.run_recipe(sales, "cohort-breakdown").count() == 3


def test_insights(spark):
    found = recipes.insights({"spike": months(spark, [100] * 9 + [400])}).collect()
    assert ("anomaly", "2024-10") in [(r.kind, r.label) for r in found]


def test_profile(sales):
    found = {r.column_name: r for r in profile.profile_columns(sales).collect()}
    assert (found["amount"].sum, found["amount"].n, found["region"].distinct_values, found["d"].least) == (405.0, 5, 3, 2024.0)
    assert profile.group_sums(sales, "region", ["amount"]).count() == 3
    assert profile.group_sums(sales, "region", ["amount"], 4, 8).isEmpty()
