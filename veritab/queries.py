"""Queries over the driver's tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.functions import text as fx
from veritab.operators import profile, ranking, recipes, retrieval, rules
from veritab.operators.semantic import Catalog
from veritab.plans.execute import run_query
from veritab.session import table
from veritab.sources.store import new_folder
from veritab.streaming.watch import windowed_totals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


STOP = "'the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'is', 'are', 'for', 'on', 'with', 'as', 'at', 'by', 'from', 'this', 'that', 'it', 'be', 'do', 'does', 'have', 'any', 'there', 'my', 'our', 'your', 'you', 'me', 'i'"
MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS total FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1")
def monthly_totals(spark, d):
    return orders(spark, d).groupBy(recipes.month("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC, c_custkey LIMIT 10")
def topn_customers(spark, d):
    sums = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    named = sums.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return named.select("c_custkey", "c_name", "total").orderBy(F.desc("total"), "c_custkey").limit(10)


@query(f"WITH {MONTHS} SELECT period, round(total, 2) AS total, round(total - lag(total) OVER (ORDER BY period), 2) AS change FROM m")
def mom_change(spark, d):
    months = recipes.monthly(orders(spark, d), "o_orderdate", "o_totalprice")
    return months.select("period", F.round("total", 2).alias("total"), F.round(F.col("total") - F.lag("total").over(Window.orderBy("period")), 2).alias("change"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(100 * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 4) AS share FROM lineitem GROUP BY 1")
def share_of_total(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("t"))
    return sums.select("l_returnflag", F.round("t", 2).alias("total"), F.round(100 * F.col("t") / F.sum("t").over(Window.partitionBy()), 4).alias("share"))


@query("SELECT n_name, round(avg(o_totalprice), 2) AS mean, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def avg_per_group_join(spark, d):
    by_customer = orders(spark, d).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    joined = by_customer.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("s") / F.sum("n"), 2).alias("mean"), F.sum("n").alias("n"))


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders GROUP BY 1")
def filtered_metric(spark, d):
    return orders(spark, d).groupBy("o_orderpriority").agg(F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))


@query("SELECT o_orderstatus, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent, max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS low FROM orders GROUP BY 1")
def case_pivot(spark, d):
    return orders(spark, d).groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("o_totalprice")).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query(f"""WITH {MONTHS}, r AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS rn FROM m),
p AS (SELECT max(CASE WHEN rn = 1 THEN period END) AS current_period, max(CASE WHEN rn = 1 THEN total END) AS c, max(CASE WHEN rn = 2 THEN period END) AS previous_period, max(CASE WHEN rn = 2 THEN total END) AS p FROM r)
SELECT current_period, round(c, 2) AS current_total, previous_period, round(p, 2) AS previous_total, round(c - p, 2) AS delta, round(100 * (c - p) / nullif(p, 0), 1) AS pct_change FROM p""")
def variance_last_period(spark, d):
    return recipes.variance_vs_last_period(orders(spark, d), "o_orderdate", "o_totalprice")


@query("SELECT o_orderpriority AS cohort, round(sum(o_totalprice), 2) AS total, round(100 * sum(o_totalprice) / nullif(sum(sum(o_totalprice)) OVER (), 0), 1) AS share_pct, count(*) AS size FROM orders GROUP BY 1")
def cohort_breakdown(spark, d):
    return recipes.cohort_breakdown(orders(spark, d), "o_orderpriority", "o_totalprice")


@query(f"""WITH {MONTHS.replace('SELECT strftime', "SELECT o_orderpriority AS g, strftime").replace('GROUP BY 1', 'GROUP BY 1, 2')}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY period DESC) AS rn FROM m),
p AS (SELECT g, max(CASE WHEN rn = 1 THEN total END) AS c, max(CASE WHEN rn = 2 THEN total END) AS p FROM r GROUP BY g)
SELECT g AS cohort, round(c, 2) AS current_total, round(p, 2) AS previous_total, round(c - p, 2) AS change, round(100 * (c - p) / nullif(p, 0), 1) AS pct_change FROM p WHERE c - p IS NOT NULL ORDER BY abs(change) DESC, cohort LIMIT 20""")
def top_movers(spark, d):
    return recipes.top_movers(orders(spark, d), "o_orderpriority", "o_totalprice", "o_orderdate")


@query("SELECT n_name AS cohort, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY abs(total) DESC, cohort LIMIT 20")
def top_movers_undated(spark, d):
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return recipes.top_movers(named, "n_name", "c_acctbal")


@query(f"WITH {MONTHS}, s AS (SELECT avg(total) AS mean, stddev_samp(total) AS sd FROM m) SELECT period, round(total, 2) AS total, round((total - mean) / nullif(sd, 0), 2) AS z FROM m CROSS JOIN s")
def anomaly_series(spark, d):
    return recipes.scored_months(orders(spark, d), "o_orderdate", "o_totalprice")


@query(f"WITH {MONTHS}, s AS (SELECT avg(total) AS mean, stddev_samp(total) AS sd FROM m) SELECT period, round(total, 2) AS total, round((total - mean) / nullif(sd, 0), 2) AS z FROM m CROSS JOIN s WHERE abs(round((total - mean) / nullif(sd, 0), 2)) > 1.5")
def anomaly_scan(spark, d):
    return recipes.anomaly_scan(orders(spark, d), "o_orderdate", "o_totalprice", 1.5)


@query(f"""WITH {MONTHS}, p AS (SELECT period, total, count(*) OVER (ORDER BY period) AS k, sum(total) OVER (ORDER BY period) AS part, count(*) OVER () AS n, sum(total) OVER () AS s, stddev_samp(total) OVER () AS sd FROM m),
q AS (SELECT period, part / k AS b, (s - part) / (n - k) AS a, sd FROM p WHERE n >= 4 AND k < n)
SELECT period, round(b, 2) AS mean_before, round(a, 2) AS mean_after, round(a - b, 2) AS delta, round(abs(a - b) / (coalesce(sd, 0) + 1e-9), 2) AS magnitude FROM q ORDER BY magnitude DESC, period LIMIT 1""")
def changepoint_scan(spark, d):
    return recipes.changepoint_scan(orders(spark, d), "o_orderdate", "o_totalprice")


FIT = f"""{MONTHS}, x AS (SELECT period, total, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS i FROM m),
f AS (SELECT regr_slope(total, i) AS slope, regr_intercept(total, i) AS intercept, sqrt(greatest(regr_syy(total, i) - regr_slope(total, i) * regr_sxy(total, i), 0) / (count(*) - 2)) AS sigma, count(*) AS n FROM x)"""


@query(f"WITH {FIT} SELECT round(slope, 2) AS slope, round(intercept, 2) AS intercept, round(sigma, 2) AS sigma, n FROM f")
def forecast_fit(spark, d):
    fit = recipes.forecast_fit(orders(spark, d), "o_orderdate", "o_totalprice")
    return fit.select(*[F.round(c, 2).alias(c) for c in ("slope", "intercept", "sigma")], "n")


@query(f"""WITH {FIT}, l AS (SELECT CAST(max(period) || '-01' AS DATE) AS d FROM m)
SELECT period, round(total, 2) AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, 'actual' AS kind FROM m
UNION ALL SELECT strftime(l.d + to_months(CAST(k AS INTEGER)), '%Y-%m'), round(intercept + slope * (n - 1 + k), 2), round(intercept + slope * (n - 1 + k) - 1.96 * sigma, 2), round(intercept + slope * (n - 1 + k) + 1.96 * sigma, 2), 'forecast' FROM f, l, range(1, 4) t(k) WHERE n >= 3""")
def forecast(spark, d):
    return recipes.forecast(orders(spark, d), "o_orderdate", "o_totalprice")


def _completeness_sql(name: str, columns: list[str]) -> str:
    each = (f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / nullif(count(*), 0), 1) AS null_pct, count(DISTINCT {c}) AS distinct_values, count({c}) - count(DISTINCT {c}) AS duplicates FROM {name}" for c in columns)
    return " UNION ALL ".join(each)


@query(_completeness_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def dq_completeness(spark, d):
    return recipes.completeness(table(spark, d, "customer"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, (SELECT count(*) FROM part WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT quantile_disc(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_disc(CAST({c} AS DOUBLE), 0.75) AS q3 FROM part)" for c in ("p_size", "p_retailprice")))
def iqr_outliers(spark, d):
    return recipes.iqr_outliers(table(spark, d, "part"), ["p_size", "p_retailprice"])


def _insight_sql() -> str:
    """Findings over orders and lineitem from the recipes' own SQL."""
    parts = []
    for name, date, metric, group in (("orders", "o_orderdate", "o_orderkey", "o_orderstatus"), ("lineitem", "l_shipdate", "l_orderkey", "l_returnflag")):
        m = f"SELECT strftime({date}, '%Y-%m') AS period, sum(CAST({metric} AS DOUBLE)) AS total FROM {name} WHERE {date} IS NOT NULL GROUP BY 1"
        z = "round((total - avg(total) OVER ()) / nullif(stddev_samp(total) OVER (), 0), 2)"
        parts.append(f"SELECT '{name}' AS table_name, 'anomaly' AS kind, period AS label, abs(z) AS magnitude FROM (SELECT period, {z} AS z FROM ({m})) WHERE abs(z) > 2")
        parts.append(f"""SELECT '{name}', 'changepoint', period, magnitude FROM (SELECT period, round(abs(a - b) / (coalesce(sd, 0) + 1e-9), 2) AS magnitude FROM (
SELECT period, part / k AS b, (s - part) / (n - k) AS a, sd FROM (SELECT period, count(*) OVER (ORDER BY period) AS k, sum(total) OVER (ORDER BY period) AS part, count(*) OVER () AS n, sum(total) OVER () AS s, stddev_samp(total) OVER () AS sd FROM ({m})) WHERE n >= 4 AND k < n)
ORDER BY magnitude DESC, period LIMIT 1) WHERE magnitude >= 1""")
        g = m.replace("SELECT strftime", f"SELECT {group} AS g, strftime").replace("GROUP BY 1", "GROUP BY 1, 2")
        parts.append(f"""SELECT '{name}', 'mover', g, abs(pct) / 100 FROM (SELECT g, round(100 * (c - p) / nullif(p, 0), 1) AS pct FROM (SELECT g, max(CASE WHEN rn = 1 THEN total END) AS c, max(CASE WHEN rn = 2 THEN total END) AS p FROM (
SELECT *, row_number() OVER (PARTITION BY g ORDER BY period DESC) AS rn FROM ({g})) GROUP BY g) WHERE c - p IS NOT NULL ORDER BY abs(round(c - p, 2)) DESC, g LIMIT 20) WHERE abs(pct) >= 25""")
    return f"SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM ({p})' for p in parts)}) ORDER BY magnitude DESC, table_name, kind, label LIMIT 8"


@query(_insight_sql())
def insight_findings(spark, d):
    return recipes.insights({"orders": orders(spark, d), "lineitem": table(spark, d, "lineitem")})


@query("""SELECT 'o_orderkey' AS column_name, 'numeric' AS kind, count(o_orderkey) AS n, round(sum(CAST(o_orderkey AS DOUBLE)), 2) AS sum, round(avg(CAST(o_orderkey AS DOUBLE)), 2) AS mean, round(CAST(min(o_orderkey) AS DOUBLE), 2) AS least, round(CAST(max(o_orderkey) AS DOUBLE), 2) AS most, CAST(NULL AS BIGINT) AS distinct_values FROM orders
UNION ALL SELECT 'o_totalprice', 'numeric', count(o_totalprice), round(sum(o_totalprice), 2), round(avg(o_totalprice), 2), round(min(o_totalprice), 2), round(max(o_totalprice), 2), NULL FROM orders
UNION ALL SELECT 'o_orderstatus', 'text', count(o_orderstatus), NULL, NULL, NULL, NULL, count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderdate', 'date', count(o_orderdate), NULL, NULL, CAST(min(year(o_orderdate)) AS DOUBLE), CAST(max(year(o_orderdate)) AS DOUBLE), NULL FROM orders""")
def table_profile_columns(spark, d):
    return profile.profile_columns(orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def profile_year_rollup(spark, d):
    return profile.year_sums(orders(spark, d), "o_orderdate", ["o_totalprice"])


@query("SELECT o_orderstatus AS label, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1 HAVING (SELECT count(DISTINCT o_orderstatus) FROM orders) BETWEEN 2 AND 8")
def profile_group_sums(spark, d):
    return profile.group_sums(orders(spark, d), "o_orderstatus", ["o_totalprice"])


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_linestatus, quantile_disc(l_quantity, 0.5) AS mid, round(var_samp(l_quantity), 6) AS var, round(stddev_samp(l_discount), 6) AS sd, bool_and(l_tax >= 0) AS sound FROM lineitem GROUP BY 1")
def median_var(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.percentile_approx("l_quantity", 0.5, 100_000).alias("mid"), F.round(F.var_samp("l_quantity"), 6).alias("var"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"), F.bool_and(F.col("l_tax") >= 0).alias("sound"))


@query("SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def union_arms(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")))


@query("(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customers only' FROM customer EXCEPT SELECT s_nationkey, 'customers only' FROM supplier)")
def intersect_except(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("customers only")))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE h) AS with_orders, count(*) FILTER (WHERE NOT h) AS without_orders FROM (SELECT c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS h FROM customer) GROUP BY 1")
def semi_anti(spark, d):
    customers, buyers = table(spark, d, "customer"), orders(spark, d).select(F.col("o_custkey").alias("c_custkey"))
    parts = [customers.join(buyers, "c_custkey", how).select("c_mktsegment", F.lit(how == "left_semi").alias("h")) for how in ("left_semi", "left_anti")]
    return reduce(DataFrame.unionByName, parts).groupBy("c_mktsegment").agg(F.count_if("h").alias("with_orders"), F.count_if(~F.col("h")).alias("without_orders"))


@query("SELECT o_orderstatus, count(*) AS above FROM orders, (SELECT avg(o_totalprice) AS mean FROM orders) WHERE o_totalprice > mean GROUP BY 1")
def one_row_join(spark, d):
    df = orders(spark, d)
    return df.where(F.col("o_totalprice") > df.agg(F.avg("o_totalprice").alias("m")).select("m").scalar()).groupBy("o_orderstatus").agg(F.count("*").alias("above"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def left_outer(spark, d):
    counts = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS INTEGER) AS r, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS pair FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
def window_functions(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("quarter"), F.round(F.sum("l_quantity").over(w.rowsBetween(-1, 0)), 2).alias("pair"))


@query("""WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS label, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, label) AS rn FROM s)
SELECT label, round(v, 2) AS value FROM r WHERE rn <= 23 UNION ALL SELECT 'Other', round((SELECT sum(v) FROM r) - (SELECT sum(round(v, 2)) FROM r WHERE rn <= 23), 2) WHERE (SELECT count(*) FROM r) > 23""")
def bucket_top_n_other(spark, d):
    sums = orders(spark, d).groupBy(F.col("o_custkey").cast("string").alias("label")).agg(F.sum("o_totalprice").alias("v"))
    return rules.top_and_other(sums, "label", "v")


@query(r"""SELECT page_id, CASE WHEN p LIKE '/en/7%' THEN true WHEN p LIKE '/en/%' THEN false WHEN regexp_matches(p, '^/de/[^/]*\.html$') THEN false ELSE true END AS included FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def curation_rules(spark, d):
    written = spark.createDataFrame([("/en/", fx.glob_pattern("/en/**"), "exclude", 0), ("/en/7", fx.glob_pattern("/en/7**"), "include", 1), ("/de/", fx.glob_pattern("/de/*.html"), "exclude", 2)], "scope string, pattern string, verdict string, position int")
    files = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return rules.decide(files, written, "page_id", "path")


@query(r"SELECT CASE WHEN url LIKE '%.html%' THEN 'html' WHEN regexp_matches(url, '[?]') THEN 'query' ELSE 'plain' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def listing_by_kind(spark, d):
    kind = F.when(F.col("url").contains(".html"), "html").when(F.col("url").contains("?"), "query").otherwise("plain")
    return table(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 26, 0) + 1, 95)) AS s FROM w WHERE len(w) > 0 AND w[1] != '')
SELECT doc_id, CAST(s // 95 AS INTEGER) AS ordinal, CAST(least(120, len(w) - s) AS INTEGER) AS words, sha256(array_to_string(w[s + 1 : s + 120], ' ')) AS chunk_sha256 FROM x""")
def prose_chunks(spark, d):
    return retrieval.chunks(table(spark, d, "documents"), "doc_id").select("doc_id", "ordinal", "words", F.sha2("chunk", 256).alias("chunk_sha256"))


TERMS = f"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN ({STOP}) GROUP BY ALL)"


@query(f"WITH {TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY 1")
def doc_freq(spark, d):
    return retrieval.document_frequency(table(spark, d, "documents"), "text")


INDEXES: dict = {}


def document_index(spark: SparkSession, d: str) -> retrieval.Index:
    """The index of the table documents, written once for each session and folder."""
    at = (spark.sparkContext.applicationId, d)
    if at not in INDEXES:
        INDEXES[at] = retrieval.build_index(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", new_folder(spark, "index"))
    return INDEXES[at]


@query(f"WITH {{TERMS}}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1) SELECT doc_id, round(sqrt(sum(pow(tf * (ln((n + 1) / (df + 1)) + 1), 2))), 6) AS norm FROM c JOIN f USING (term), n GROUP BY 1".replace("{TERMS}", TERMS))
def index_norms(spark, d):
    return document_index(spark, d).norms.select("doc_id", F.round("norm", 6).alias("norm"))


QUERY_TERMS = ["thing", "nation", "hand", "thing"]


@query(f"""WITH {TERMS}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT c.doc_id, c.term, tf * (ln((n + 1) / (df + 1)) + 1) AS w, ln((n + 1) / (df + 1)) + 1 AS idf FROM c JOIN f USING (term), n),
q AS (SELECT term, CAST(count(*) AS DOUBLE) AS k FROM (SELECT unnest({QUERY_TERMS!r}) AS term) GROUP BY 1),
qn AS (SELECT sqrt(sum(pow(coalesce(k * (ln((n + 1) / (df + 1)) + 1), ln(n + 1) + 1), 2))) AS norm FROM q LEFT JOIN f USING (term), n),
s AS (SELECT doc_id, sum(CASE WHEN k IS NULL THEN 0 ELSE w * k * idf END) AS dot, sqrt(sum(w * w)) AS norm FROM w LEFT JOIN q USING (term) GROUP BY 1)
SELECT doc_id, round(dot / (s.norm * qn.norm), 6) AS score FROM s, qn WHERE dot > 0 ORDER BY round(dot / (s.norm * qn.norm), 6) DESC, doc_id LIMIT 20""")
def tfidf_topk(spark, d):
    scored = document_index(spark, d).search(QUERY_TERMS)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    wanted = vectors.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.nearest(vectors, F.array(*[F.lit(float(x)) for x in wanted]), 10)


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS a, CAST(label AS DOUBLE) AS b FROM embeddings, q),
x AS (SELECT vec_id, 30.5 / (60 + row_number() OVER (ORDER BY a DESC, vec_id)) AS p, row_number() OVER (ORDER BY a DESC, vec_id) AS r FROM s UNION ALL SELECT vec_id, 30.5 / (60 + row_number() OVER (ORDER BY b DESC, vec_id)), row_number() OVER (ORDER BY b DESC, vec_id) FROM s)
SELECT vec_id, round(sum(CAST(p AS DOUBLE)), 6) AS score FROM x WHERE r <= 400 GROUP BY 1""")
def rrf_fusion(spark, d):
    vectors = table(spark, d, "embeddings")
    wanted = vectors.where("vec_id = 0").select("embedding").first()[0]
    a = vectors.select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in wanted])), 6).alias("score"))
    return retrieval.fuse(a, vectors.select("vec_id", F.col("label").cast("double").alias("score")), "vec_id")


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({STOP}))) AS w FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, len(list_intersect(w, ['thing', 'ing', 'tion', 'hand', 'er'])) AS overlap FROM t),
b AS (SELECT conv_id, turn, CAST(overlap AS INTEGER) AS overlap, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS rn FROM s WHERE overlap >= 2)
SELECT conv_id, turn, overlap FROM b WHERE rn = 1 ORDER BY overlap DESC, conv_id LIMIT 3""")
def recall_related(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_distinct(fx.tokens(F.col("text"))).alias("terms"))
    return rules.recall(asked, ["thing", "ing", "tion", "hand", "er"], "conv_id", "turn", "terms")


@query(r"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '\[\d+\]', ' ', 'g'), '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')))) AS numbers FROM documents")
def number_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(fx.number_tokens(F.col("text"))).cast("long").alias("numbers"))


@query("SELECT doc_id, CAST(ceil(length(regexp_replace(text, '[^0-9]', '', 'g')) / 2) + ceil((length(text) - length(regexp_replace(text, '[^0-9]', '', 'g'))) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return windowed_totals(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > 1800) AS sessions FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) GROUP BY 1")
def event_sessions(spark, d):
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts"))
    return table(spark, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > 1_800_000_000)).alias("sessions"))


def _catalog(spark: SparkSession, d: str) -> Catalog:
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"vt_{name}")
    catalog = Catalog(spark, ["vt_orders", "vt_customer"])
    catalog.create_view("vt_open", "SELECT * FROM vt_orders WHERE o_orderstatus = 'O'")
    catalog.create_view("vt_open_by_priority", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM vt_open GROUP BY o_orderpriority")
    return catalog


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def view_over_view(spark, d):
    _catalog(spark, d)
    return spark.table("vt_open_by_priority")


#: A statement's name, its text, and the answer to check if that isn't the statement's own.
RECONCILED = {
    "plain": ("SELECT SUM(o_totalprice) AS revenue FROM vt_orders", None),
    "unnamed": ("SELECT o_orderstatus, sum( O_TOTALPRICE ) FROM vt_orders GROUP BY o_orderstatus", None),
    "alias": ("SELECT year(o_orderdate) AS y, SUM(o_totalprice) AS revenue FROM vt_orders GROUP BY y", None),
    "ordinal": ("SELECT o_orderpriority, SUM(o_totalprice) AS revenue FROM vt_orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC", None),
    "subquery": ("SELECT SUM(o_totalprice) AS revenue FROM vt_orders WHERE o_custkey IN (SELECT c_custkey FROM vt_customer WHERE c_acctbal < 0)", None),
    "join": ("SELECT c_mktsegment, SUM(o_totalprice) AS revenue FROM vt_orders JOIN vt_customer ON o_custkey = c_custkey GROUP BY c_mktsegment", None),
    "empty": ("SELECT o_orderstatus, SUM(o_totalprice) AS revenue FROM vt_orders WHERE o_totalprice < 0 GROUP BY o_orderstatus", None),
    "near miss": ("SELECT SUM(o_totalprice * 2) AS revenue FROM vt_orders", None),
    "other figures": ("SELECT SUM(o_totalprice) AS revenue FROM vt_orders", "SELECT SUM(o_totalprice) AS revenue FROM vt_orders WHERE o_orderstatus = 'F'"),
}


def _reconcile_sql() -> str:
    """A count of values for each statement, by DuckDB's own run of both sides; a statement without the metric has none."""
    parts = []
    for name, (sql, shown) in RECONCILED.items():
        own, other = (x.replace("vt_", "") for x in (sql, shown or sql))
        certified = "* 2" not in sql
        same = f"(SELECT count(*) FROM ({own})) > 0 AND NOT EXISTS (SELECT * FROM ((FROM ({own}) EXCEPT ALL FROM ({other})) UNION ALL (FROM ({other}) EXCEPT ALL FROM ({own}))))" if certified else "false"
        parts.append(f"SELECT '{name}' AS statement, {str(certified).lower()} AS certified, {same} AS reconciled, {f'(SELECT count(*) FROM ({own}))' if certified else '0'} AS expected_values")
    return " UNION ALL ".join(parts)


@query(_reconcile_sql())
def metric_reconcile(spark, d):
    catalog = _catalog(spark, d)
    table(spark, d, "customer").createOrReplaceTempView("vt_customer")
    catalog.tables.append("vt_customer")
    catalog.create_metric("revenue", "sum(o_totalprice)", "vt_orders")
    rows = []
    for name, (sql, shown) in RECONCILED.items():
        verdict = catalog.reconcile(sql, "revenue", spark.sql(shown) if shown else None)
        told = 0 if not verdict.expected else int(verdict.expected.split()[0]) if "values" in verdict.expected else 1
        rows.append((name, "revenue" in catalog.certified(sql), verdict.reconciled, told))
    return spark.createDataFrame(rows, "statement string, certified boolean, reconciled boolean, expected_values long")


@query("SELECT o_orderkey, o_totalprice, n > 200 AS truncated, n AS total FROM (SELECT *, count(*) OVER () AS n FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def capped_query(spark, d):
    """The rows that a capped run shows, with what it tells of the rest."""
    orders(spark, d).createOrReplaceTempView("vt_orders")
    found = run_query(spark, "SELECT o_orderkey, o_totalprice FROM vt_orders ORDER BY o_totalprice DESC, o_orderkey", ["vt_orders"], seconds=120)
    return spark.createDataFrame([(*r, found.truncated, found.total) for r in found.rows], "o_orderkey long, o_totalprice double, truncated boolean, total long")


@query("""WITH h AS (SELECT event_type || ' by user ' || user_id AS text, epoch_ms(ts) AS ts FROM events),
k AS (SELECT lower(text) AS key, max(ts) AS ts, count(*) AS n FROM h GROUP BY 1),
s AS (SELECT key, ts, n, regexp_extract(key, 'c.*?k.*?2', 0) AS w FROM k)
SELECT key AS text, 'history' AS source, round(CASE WHEN starts_with(key, 'ck2') THEN 1100 ELSE 300.0 / length(w) END + 40 * pow(0.5, greatest(0, 1706659200000 - ts) / 604800000.0) + 20 * least(1, (n - 1) / 7.0), 6) AS score
FROM s WHERE w != '' ORDER BY score DESC, text LIMIT 6""")
def type_ahead(spark, d):
    events = table(spark, d, "events")
    text = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))
    history = events.select(text.alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.lit(1).alias("count"))
    return ranking.past_questions(history, spark.createDataFrame([], "text string"), "ck2", 1_706_659_200_000)


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand || '/' || p_name AS path, regexp_extract(lower(p_name), 'b.*?o.*?t', 0) AS w, regexp_extract(lower(p_brand || '/' || p_name), 'b.*?o.*?t', 0) AS v FROM part)
SELECT id, name, path, round(CASE WHEN w != '' THEN CASE WHEN starts_with(lower(name), 'bot') THEN 2000 ELSE 1000 END + 300.0 / length(w) ELSE 300.0 / length(v) END, 6) AS score
FROM s WHERE w != '' OR v != '' ORDER BY score DESC, length(path), path, id LIMIT 12""")
def quick_open(spark, d):
    path = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), path.alias("path"), F.lit("file").alias("kind"))
    return ranking.quick_open(items, "bot")


@query("""WITH p AS (SELECT l_shipmonth, 100.0 * count(*) FILTER (WHERE l_linestatus = 'O') / count(*) AS o, 100.0 * count(*) FILTER (WHERE l_linestatus <> 'O') / count(*) AS f FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_linestatus FROM lineitem) GROUP BY 1)
SELECT bool_and(o >= 0 AND f >= 0) AND min(o + f) >= 99.5 AND max(o + f) <= 100.5 AS stackable FROM p""")
def chart_stackable(spark, d):
    lines = table(spark, d, "lineitem").groupBy(recipes.month("l_shipdate").alias("period"))
    shares = lines.agg((100.0 * F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("o"), (100.0 * F.count_if(F.col("l_linestatus") != "O") / F.count("*")).alias("f"))
    return ranking.stackable(shares, ["o", "f"])
