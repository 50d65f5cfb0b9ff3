"""More queries over the driver's tables: statements that run through the guard as SQL, charts, cards, rules and stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import text as fx
from veritab.operators import charts, recipes, retrieval, rules, stores
from veritab.operators.semantic import SHORT_FORMS, closure, propose_synonyms
from veritab.plans import cards
from veritab.plans.guard import guard
from veritab.plans.qualify import rewritten
from veritab.queries import ORACLE, STOP, query
from veritab.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def guarded(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The statement's rows, if the guard lets it read the tables of the folder."""
    for name in TABLES:
        if cards.mentions(sql, name):
            table(spark, d, name).createOrReplaceTempView(name)
    sql = rewritten(sql)
    guard(spark, sql, TABLES)
    return spark.sql(sql)


#: Statements that both engines take as they are; the guard admits each before Spark runs it.
STATEMENTS = {
    "sql_cte_chain": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT c_mktsegment, count(*) AS n, round(sum(s), 2) AS total FROM a JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment) SELECT c_mktsegment, n, total FROM b WHERE n > 0",
    "sql_derived_table": "SELECT n_name, x.n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) x JOIN nation ON x.c_nationkey = n_nationkey",
    "sql_subqueries": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)",
    "sql_predicates": "SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_brand ILIKE 'BRAND%' AS branded FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN (SELECT p_type FROM part WHERE p_size < 10) AND p_name NOT LIKE 'zz%'",
    "sql_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 3 AND sum(o_totalprice) > 10000",
    "sql_right_outer": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_full_outer": "SELECT c.k AS customer_nation, s.k AS supplier_nation FROM (SELECT DISTINCT c_nationkey AS k FROM customer) c FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON c.k = s.k",
    "sql_natural_join": "SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM nation GROUP BY n_regionkey) x NATURAL JOIN (SELECT r_regionkey AS k, max(r_name) AS b FROM region GROUP BY r_regionkey) y",
    "sql_theta_join": "SELECT a.r_name AS lower_name, b.r_name AS upper_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "sql_set_operations_all": "(SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT CAST(c_nationkey % 5 AS INT) FROM customer) UNION ALL (SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region)",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_window_frames": "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, lead(o_orderkey) OVER w AS following, first_value(o_orderkey) OVER w AS first_key, nth_value(o_orderkey, 2) OVER w AS second_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "sql_values": "SELECT v.k, r_name FROM (VALUES (0, 'x'), (2, 'y'), (9, 'z')) v(k, t) LEFT JOIN region ON r_regionkey = v.k",
    "sql_case_dates": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size, EXTRACT(YEAR FROM o_orderdate) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS following, lpad(CAST(o_custkey AS STRING), 8, '0') AS padded, replace(o_orderpriority, '-', ' ') AS said, concat(o_orderstatus, ':', o_orderpriority) AS both_ FROM orders",
    "sql_qualify": "WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3) SELECT x.o_custkey, x.n, rank() OVER w AS place FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM t GROUP BY o_custkey HAVING count(*) > 1 QUALIFY total > avg(sum(o_totalprice)) OVER ()) x WINDOW w AS (ORDER BY x.total DESC, x.o_custkey) QUALIFY place <= 50 AND 'QUALIFY' <> 'x' ORDER BY place",
    "sql_qualify_distinct": "SELECT DISTINCT p_brand, p_size % 5 AS k FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, k) > 3 UNION ALL SELECT p_brand, max(p_size) FROM part GROUP BY p_brand QUALIFY dense_rank() OVER (ORDER BY max(p_retailprice) DESC) = 1",
    "sql_order_limit": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7 OFFSET 2",
}
for _name, _sql in STATEMENTS.items():

    def _run(spark, d, _sql=_sql):
        return guarded(spark, d, _sql)

    _run.__name__ = _name
    query(_sql)(_run)


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1".replace("list_sort(list(DISTINCT o_orderpriority))", "array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',')"))
def sql_array_agg(spark, d):
    return guarded(spark, d, "SELECT o_orderstatus, array_join(array_sort(collect_set(o_orderpriority)), ',') AS priorities FROM orders GROUP BY o_orderstatus")


@query("SELECT l_returnflag, CAST(round(count(DISTINCT l_returnflag || l_linestatus || l_quantity % 7)) AS BIGINT) AS combinations FROM lineitem GROUP BY 1")
def sql_approx_distinct(spark, d):
    """Few enough values that a sketch of one per cent tells their exact number."""
    return guarded(spark, d, "SELECT l_returnflag, approx_count_distinct(concat(l_returnflag, l_linestatus, CAST(l_quantity % 7 AS STRING)), 0.01) AS combinations FROM lineitem GROUP BY l_returnflag")


@query("UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME measure VALUE amount")
def sql_unpivot(spark, d):
    return guarded(spark, d, "SELECT p_partkey, measure, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR measure IN (size, price))")


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lang || ' ' || source, ' ')) AS word FROM documents) GROUP BY 1, 2")
def sql_unnest(spark, d):
    return guarded(spark, d, "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, explode(split(concat(lang, ' ', source), ' ')) AS word FROM documents) GROUP BY doc_id, word")


def _chart_rows(chart: charts.Chart) -> DataFrame:
    return chart.rows.select(F.lit(chart.kind).alias("kind"), "label", *[F.round(s, 2).alias(s) for s in chart.series])


@query("SELECT 'area' AS kind, strftime(o_orderdate, '%Y-%m') AS label, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2")
def chart_area(spark, d):
    return _chart_rows(charts.auto_chart(guarded(spark, d, "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1")))


@query("SELECT 'line' AS kind, CAST(year(o_orderdate) AS VARCHAR) AS label, round(sum(o_totalprice), 2) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 2")
def chart_lines(spark, d):
    return _chart_rows(charts.auto_chart(guarded(spark, d, "SELECT year(o_orderdate) AS yr, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1")))


@query("""WITH s AS (SELECT n_name AS label, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, label) AS rn FROM s), big AS (SELECT count(*) > 24 AS b FROM s)
SELECT 'bar' AS kind, label, round(v, 2) AS total FROM r, big WHERE NOT b OR rn <= 23 UNION ALL SELECT 'bar', 'Other', round((SELECT sum(v) FROM r) - (SELECT sum(round(v, 2)) FROM r WHERE rn <= 23), 2) FROM big WHERE b""")
def chart_bars(spark, d):
    return _chart_rows(charts.auto_chart(guarded(spark, d, "SELECT n_name, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")))


@query("SELECT 'scatter' AS kind, CAST(p_retailprice AS VARCHAR) AS label, CAST(p_size AS DOUBLE) AS size FROM part")
def chart_scatter(spark, d):
    return _chart_rows(charts.auto_chart(table(spark, d, "part").select("p_retailprice", F.col("p_size").alias("size"))))


@query("SELECT 'bar' AS kind, o_orderpriority AS label, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2")
def chart_directed(spark, d):
    result = guarded(spark, d, "SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_orderpriority")
    return _chart_rows(charts.directed_chart(result, "bar", "o_orderpriority", ["total"], "desc"))


@query("SELECT (SELECT count(DISTINCT o_custkey) FROM orders) > 10 AS top_ten, false AS monthly, true AS percent, 'month' AS grain")
def chart_refinements(spark, d):
    sums = guarded(spark, d, "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey")
    months = guarded(spark, d, "SELECT date_format(o_orderdate, 'yyyy-MM') AS month FROM orders")
    return charts.refinements(sums).select("top_ten", "monthly", "percent", charts.grain(months, "month").select("grain").scalar().alias("grain"))


@query("SELECT 'mean price' AS label, round(avg(o_totalprice), 2) AS now, round(avg(o_totalprice) - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS delta FROM orders")
def stat_tile(spark, d):
    tile = charts.stat_tile(guarded(spark, d, "SELECT 'mean price' AS what, avg(o_totalprice) AS mean FROM orders"))
    before = charts.stat_tile(guarded(spark, d, "SELECT avg(o_totalprice) AS mean FROM orders WHERE o_orderstatus = 'F'"))
    return spark.createDataFrame([(tile[0], round(tile[1], 2), round(charts.stat_delta(before[1], tile[1])[0], 2))], "label string, now double, delta double")


_KINDS = "CASE WHEN data_type LIKE '%INT%' OR data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'date' ELSE 'text' END"
_CATALOG = f"SELECT table_name, column_name, {_KINDS} AS kind FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'nation', 'events')"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return cards.column_catalog({name: table(spark, d, name) for name in ("customer", "orders", "nation", "events")})


@query(_CATALOG)
def column_catalog(spark, d):
    return _catalog(spark, d)


@query(f"""WITH q AS (SELECT ['orders', 'by', 'nation', 'custkey', 'totalprice'] AS q), w AS (SELECT table_name, list_distinct(flatten(list(regexp_extract_all(lower(column_name), '[a-z0-9]{{2,}}')))) AS c FROM ({_CATALOG}) GROUP BY 1)
SELECT table_name, CAST(3 * len(list_intersect(c, q)) + 2 * len(list_intersect(regexp_extract_all(lower(table_name), '[a-z0-9]{{2,}}'), q)) AS INTEGER) AS score FROM w, q ORDER BY score DESC, table_name LIMIT 3""")
def ranked_tables(spark, d):
    return cards.ranked_tables(_catalog(spark, d), F.lit("orders by nation: o_custkey, o_totalprice")).withColumn("score", F.col("score").cast("int"))


@query("SELECT * FROM (SELECT 'total' AS column_name, count(total) AS n, round(sum(total), 2) AS total, min(total) AS least, max(total) AS most FROM (SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_orderpriority) UNION ALL SELECT 'n', count(n), round(sum(n), 2), min(n), max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))")
def fact_sheet(spark, d):
    return cards.fact_sheet(guarded(spark, d, "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_orderpriority"))


@query("SELECT c_mktsegment AS kind, count(*) AS files FROM customer GROUP BY 1")
def inventory_by_kind(spark, d):
    return rules.inventory(table(spark, d, "customer"), "c_mktsegment").withColumn("files", F.col("files").cast("long"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderdate AS saved FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 31 DAY ORDER BY saved DESC, name LIMIT 15")
def whats_new(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderdate").alias("saved"))
    newest = files.agg(F.max("saved").alias("m")).select("m").scalar()
    return rules.whats_new(files, "saved", newest, 31)


@query(f"SELECT table_name, column_name FROM ({_CATALOG}) WHERE lower(column_name) LIKE '%key%'")
def tables_with_column(spark, d):
    return rules.with_column(_catalog(spark, d), "key")


@query(r"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN false WHEN page_id % 5 = 0 THEN true WHEN p LIKE '/en/%' THEN false ELSE true END AS included FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def curation_precedence(spark, d):
    files = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"), F.when(F.col("page_id") % 5 == 0, True).alias("own"), F.when(F.col("page_id") % 7 == 0, "/away").alias("away"))
    written = spark.createDataFrame([("/en/", fx.glob_pattern("/en/**"), "exclude", 0), ("/de/", fx.glob_pattern("/de/**"), "exclude", 1), ("/de/", fx.glob_pattern("/de/**"), "clear", 2)], "scope string, pattern string, verdict string, position int")
    return rules.decide_all(files, written, "page_id", "path", "own", "away")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey NOT IN (1, 2)")
def shareable_files(spark, d):
    files = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") >= 0).alias("included"))
    return rules.shareable(files, files.where("c_nationkey IN (1, 2)"), "c_custkey", True).select("c_custkey")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION SELECT r_name FROM region WHERE r_regionkey = 1 UNION SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def local_only_closure(spark, d):
    nations, regions, customers = (table(spark, d, t) for t in ("nation", "region", "customer"))
    edges = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("reads"))
    edges = edges.unionAll(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("reads")))
    return closure(edges, regions.where("r_regionkey = 1").select(F.col("r_name").alias("name")))


@query(f"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || r_name || ' region ' || n_name || ' desc ' || lower(p_type)), '[a-z]+')) AS w FROM part, region, nation),
forms AS (SELECT unnest({[a for p in SHORT_FORMS for a in p]!r}) AS w, unnest({[b for x, y in SHORT_FORMS for b in (y, x)]!r}) AS term)
SELECT term, w AS column_name FROM words JOIN forms USING (w) WHERE term NOT IN (SELECT w FROM words) AND term NOT IN (SELECT lower(c_mktsegment) FROM customer)""")
def synonym_proposals(spark, d):
    """Columns are the words of the names of parts, regions and nations; known terms are the market segments."""
    words = lambda *c: F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", *c)), F.lit("[a-z]+"), F.lit(0)))
    named = [table(spark, d, "part").select(words("p_name", "p_type")), table(spark, d, "region").select(words(F.lit("region"), "r_name")), table(spark, d, "nation").select(words(F.lit("desc"), "n_name"))]
    columns = reduce(DataFrame.unionAll, named).toDF("column_name")
    return propose_synonyms(columns, table(spark, d, "customer").select(F.col("c_mktsegment").alias("term")))


@query("SELECT event_type AS host, CAST(user_id % 3 AS VARCHAR) AS purpose, count(*) AS calls, max(ts) AS last FROM events GROUP BY 1, 2")
def egress_rollup(spark, d):
    return stores.egress(table(spark, d, "events").select(F.col("event_type").alias("host"), (F.col("user_id") % 3).cast("string").alias("purpose"), F.col("ts").alias("at")))


@query("SELECT event_type AS expression, CAST(user_id AS VARCHAR) AS entity, count(*) AS n, event_type = 'click' AND user_id = 1 AS certified FROM events GROUP BY 1, 2, 4 HAVING count(*) >= 8 OR (event_type = 'click' AND user_id = 1)")
def usage_tally(spark, d):
    used = table(spark, d, "events").select(F.col("event_type").alias("expression"), F.col("user_id").cast("string").alias("entity"))
    return stores.usage(used, spark.createDataFrame([("click", "1")], "expression string, entity string"), 8)


@query("SELECT conv_id AS board, turn AS position, 'pin-' || sha1(coalesce(role, '') || chr(0) || coalesce(text, ''))[1:12] AS pin, CASE WHEN role = 'user' THEN NULL ELSE role END AS title, role = 'user' AS gone FROM conversations")
def board_cards(spark, d):
    talk = table(spark, d, "conversations")
    pin = F.concat(F.lit("pin-"), F.substring(F.sha1(F.concat(F.coalesce("role", F.lit("")), F.lit("\u0000"), F.coalesce("text", F.lit("")))), 1, 12))
    cards_ = talk.select(F.col("conv_id").alias("board"), F.col("turn").alias("position"), pin.alias("pin"))
    pins = talk.where("role <> 'user'").select(pin.alias("pin"), F.col("role").alias("title")).distinct()
    return stores.board_cards(cards_, pins)


@query("SELECT o_orderkey AS name FROM orders WHERE o_orderpriority = '1-URGENT' AND epoch(TIMESTAMP '1997-06-01') - epoch(o_orderdate) >= 86400 OR o_orderpriority = '5-LOW' AND epoch(TIMESTAMP '1997-06-01') - epoch(o_orderdate) >= 604800")
def briefings_due(spark, d):
    schedule = F.when(F.col("o_orderpriority") == "1-URGENT", "daily").when(F.col("o_orderpriority") == "5-LOW", "weekly").otherwise("manual")
    made = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), schedule.alias("schedule"), F.col("o_orderdate").cast("timestamp").alias("last_run"))
    return stores.due(made, F.lit("1997-06-01 00:00:00").cast("timestamp")).select("name")


@query("""WITH s AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, count(*) OVER (PARTITION BY conv_id) AS n, first(role) OVER (PARTITION BY conv_id ORDER BY turn) AS opens FROM conversations),
x AS (SELECT conv_id, max(n) AS n, max(opens) AS opens FROM s GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN opens = 'system' THEN n WHEN n = 8 THEN n + 1 WHEN n = 5 THEN n - 1 ELSE n END AS BIGINT) AS records, CAST(CASE WHEN opens = 'system' THEN CASE WHEN n >= 2 THEN 2 END WHEN n = 8 THEN 3 WHEN n = 5 THEN 5 END AS BIGINT) AS broken FROM x""")
def audit_chain(spark, d):
    """A log for each conversation. Where a system message opens it, the second record was changed; one of eight has its third
    record twice; one of five lacks its fourth."""
    talk = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("at"), F.to_json(F.struct("role", "text")).alias("payload"), "role")
    log = stores.chained(talk, ["conv_id"], "key")
    kinds = talk.groupBy("conv_id").agg(F.count("*").alias("n"), (F.min_by("role", "at") == "system").alias("system"))
    known = log.join(kinds, "conv_id")
    known = known.withColumn("payload", F.when(F.col("system") & (F.col("seq") == 2), F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    times = F.when(~F.col("system") & (F.col("n") == 8) & (F.col("seq") == 3), 2).when(~F.col("system") & (F.col("n") == 5) & (F.col("seq") == 4), 0).otherwise(1)
    return stores.verified(known.withColumn("_k", F.explode(F.array_repeat(F.lit(1), times))), "key", ["conv_id"])


@query(f"""WITH q AS (SELECT ['large', 'box', 'steel'] AS q), s AS (SELECT p_partkey, list_distinct(list_transform(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({STOP})), lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' THEN x[1:-2] ELSE x END)) AS t FROM part),
h AS (SELECT p_partkey, len(list_intersect(t, q)) AS n, len(list_filter(list_intersect(t, q), lambda x: length(x) >= 4)) > 0 AS long_one FROM s, q),
hits AS (SELECT l_partkey AS p_partkey, count(*) / 100.0 AS score FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT p_partkey, round(CASE WHEN score IS NULL THEN 0.5 + 0.4 * (CASE WHEN long_one THEN n ELSE 0 END) / 3 ELSE score + 0.2 * (CASE WHEN long_one THEN n ELSE 0 END) / 3 END, 6) AS score FROM h LEFT JOIN hits USING (p_partkey) WHERE score IS NOT NULL OR long_one""")
def name_boost(spark, d):
    """Hits are the parts of large orders; names are the parts'."""
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    hits = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.count("*") / F.lit(100.0)).alias("score"))
    return retrieval.boosted(hits, names, "p_partkey", ["large", "box", "steel"])


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(text, chr(13), ''), '\\n[ \\t]*(\\n[ \\t]*)+', chr(10), 'g'), chr(10)), lambda x: trim(x) != '') AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 1 - 6, 0) + 1, 25)) AS a FROM t WHERE len(l) > 1)
SELECT doc_id, CAST(a // 25 AS INTEGER) AS ordinal, CAST(least(30, len(l) - 1 - a) AS INTEGER) AS rows, sha256(array_to_string(list_concat(l[1:1], l[a + 2 : a + 31]), chr(10))) AS chunk_sha256 FROM s""")
def tabular_chunks(spark, d):
    whole = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "\r", ""), r"\n[ \t]*(\n[ \t]*)+", "\n").alias("text"))
    return retrieval.tabular_chunks(whole, "doc_id").select("doc_id", "ordinal", "rows", F.sha2("chunk", 256).alias("chunk_sha256"))


@query("SELECT o_custkey AS file, round(s / max(s) OVER (), 6) AS score FROM (SELECT o_custkey, sum(CAST(o_orderkey AS DOUBLE)) AS s FROM orders GROUP BY 1) ORDER BY score DESC, file LIMIT 10")
def ranked_documents(spark, d):
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").cast("double").alias("score"))
    return retrieval.ranked_documents(hits, "file", 10)


@query("SELECT doc_id, regexp_matches(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' (sum|total|mean|count|top|share|rank|per|how many) ') AS asks FROM documents")
def intent_cues(spark, d):
    return table(spark, d, "documents").select("doc_id", cards.has_cue(F.col("text"), ("sum", "total", "mean", "count", "top", "share", "rank", "per", "how many")).alias("asks"))


@query(f"SELECT 'band' AS kind, period AS label, value, lower, upper FROM ({ORACLE['forecast']})")
def chart_forecast(spark, d):
    chart = charts.recipe_chart("forecast", recipes.forecast(table(spark, d, "orders"), "o_orderdate", "o_totalprice"))
    return chart.rows.select(F.lit(chart.kind).alias("kind"), "label", "value", "lower", "upper")
