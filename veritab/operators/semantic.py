"""Saved views and metrics: a governed layer of named statements over registered tables."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import sanitize
from veritab.plans.execute import Result, run_query
from veritab.plans.guard import Refused, guard, items, name_of, parse, parser, reads
from veritab.plans.trees import canonical, text_of, with_column
from veritab.plans.wholes import whole_digest
from veritab.sources.store import new_folder, written

DEPTH = 3
#: Times that a mined expression must be used, unless a certified answer uses it.
RECURRING = 2
#: Shapes of statements that one mining run takes.
SHAPES = 20_000
AGGREGATES = ("sum(", "avg(", "count(", "min(", "max(", "median(", "stddev", "var_", "approx_count_distinct(", "percentile")


@dataclass
class View:
    name: str
    sql: str
    reads: list[str]


@dataclass
class Metric:
    name: str
    expression: str
    entity: str


@dataclass
class Verdict:
    """Whether a statement computes a metric, and whether the metric computed anew gives the answer's values; both as one value,
    or as a number of values and their digest. reason: why the metric could not be computed anew."""

    certified: bool
    reconciled: bool = False
    metric: str | None = None
    expected: str | None = None
    got: str | None = None
    reason: str | None = None


#: Column words and their usual short forms.
SHORT_FORMS = (("amount", "amt"), ("quantity", "qty"), ("region", "rgn"), ("number", "num"), ("description", "desc"), ("category", "cat"), ("customer", "cust"), ("account", "acct"), ("department", "dept"), ("revenue", "rev"), ("average", "avg"), ("transaction", "txn"), ("reference", "ref"), ("balance", "bal"), ("percent", "pct"), ("organization", "org"), ("identifier", "ident"), ("address", "addr"))
DEFINITIONS = 24


@dataclass
class Catalog:
    """Views, metrics and synonyms over the session's temporary views; local_only names tables that never leave the machine."""

    spark: SparkSession
    tables: list[str]
    views: dict[str, View] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    local_only: set[str] = field(default_factory=set)

    def depth(self, name: str) -> int:
        return 1 + max(map(self.depth, self.views[name].reads), default=0) if name in self.views else 0

    def create_view(self, name: str, sql: str) -> View:
        """Guards the statement, refuses names in use, cycles and views deeper than three."""
        name = sanitize(name)
        if name in self.views or name in self.tables:
            raise Refused(f"{name} is in use")
        found = guard(self.spark, sql, [*self.tables, *self.views])
        if 1 + max(map(self.depth, map(str.lower, found)), default=0) > DEPTH:
            raise Refused(f"a view stands on {DEPTH} others at most")
        self.spark.sql(sql).createOrReplaceTempView(name)
        self.views[name] = View(name, sql, [n.lower() for n in found])
        return self.views[name]

    def dependents(self, name: str) -> list[str]:
        """All views that stand on a view, directly or not."""
        out = [v for v, d in self.views.items() if name in d.reads]
        return list(dict.fromkeys([*out, *(x for v in out for x in self.dependents(v))]))

    def drop_view(self, name: str, cascade: bool = False) -> list[str]:
        others = self.dependents(name)
        if others and not cascade:
            raise Refused(f"{', '.join(others)} need {name}")
        for v in [name, *others]:
            self.spark.catalog.dropTempView(v)
            del self.views[v]
        return [name, *others]

    def rename_view(self, name: str, new: str) -> View:
        """Refused where another view stands on it, or the new name is in use."""
        new = sanitize(new)
        if others := self.dependents(name):
            raise Refused(f"{', '.join(others)} need {name}")
        if new in self.views or new in self.tables:
            raise Refused(f"{new} is in use")
        view = self.views.pop(name)
        self.spark.catalog.dropTempView(name)
        self.spark.sql(view.sql).createOrReplaceTempView(new)
        self.views[new] = View(new, view.sql, view.reads)
        return self.views[new]

    def resolve(self, tables: list[str]) -> list[str]:
        """The views that hold over these tables alone, in the order they were made: all that a view reads must be a table or a
        view that holds. A table of a view's name hides it."""
        known = {t.lower() for t in tables}
        out: list[str] = []
        for name, view in self.views.items():
            if name not in known and set(view.reads) <= known | set(out):
                out.append(name)
        return out

    def posture(self, cloud: bool) -> list[str]:
        """The views that may be read: all of them, or where the answer leaves the machine those that rest on nothing private."""
        return [v for v in self.views if not (cloud and self.private(v))]

    def run(self, sql: str, tables: list[str], cloud: bool = False, most: int = 6, **limits) -> Result:
        """Runs a statement over tables and the views that hold over them and may be read, tables first and views in the order they
        were made, `most` names in all. Each view is made anew from its statement in this pass; one that cannot be made is
        left out, and so is what stands on it."""
        allowed = [t for t in tables if not (cloud and t.lower() in self.local_only)][:most]
        open_to = set(self.posture(cloud))
        known = {t.lower() for t in allowed}
        for name, view in self.views.items():
            if len(known) >= most or name in known or name not in open_to or not set(view.reads) <= known:
                continue
            try:
                guard(self.spark, view.sql, sorted(known))
                self.spark.sql(view.sql).createOrReplaceTempView(name)
            except Exception:
                continue
            known.add(name)
        return run_query(self.spark, sql, sorted(known), **limits)

    def private(self, name: str) -> bool:
        """Whether a table, a view or a metric rests on a table that never leaves the machine."""
        if name in self.metrics:
            return self.private(self.metrics[name].entity.lower())
        return name in self.local_only or any(self.private(r) for r in (self.views[name].reads if name in self.views else ()))

    def create_synonym(self, term: str, target: str) -> None:
        """A term that means a metric or a column; refused where the term is a metric or has a meaning."""
        term = term.strip().lower()
        if not term or term in self.metrics or term in self.synonyms:
            raise Refused(f"{term or 'a term'} is in use or empty")
        self.synonyms[term] = target

    def rename_metric(self, name: str, new: str) -> Metric:
        """Synonyms of the metric follow."""
        if new in self.metrics or new in self.spark.table(self.metrics[name].entity).columns:
            raise Refused(f"{new} is in use")
        old = self.metrics.pop(name)
        self.metrics[new] = Metric(new, old.expression, old.entity)
        self.synonyms = {t: new if x == name else x for t, x in self.synonyms.items()}
        return self.metrics[new]

    def delete_metric(self, name: str, cascade: bool = False) -> list[str]:
        """The synonyms that went with it; refused where there are any and cascade is not asked for."""
        terms = [t for t, x in self.synonyms.items() if x == name]
        if terms and not cascade:
            raise Refused(f"{', '.join(terms)} mean {name}")
        del self.metrics[name]
        for t in terms:
            del self.synonyms[t]
        return terms

    def definitions(self, question: str | None = None, most: int = DEFINITIONS) -> list[str]:
        """A line for each of the newest metrics and synonyms; with a question only of those that it names."""
        lines = [(m.name, f"{m.name} = {m.expression} over {m.entity}") for m in reversed(self.metrics.values())]
        lines += [(t, f"{t} means {x}") for t, x in reversed(self.synonyms.items())]
        asked = f" {question.lower()} " if question is not None else None
        return [text for name, text in lines if asked is None or name.replace("_", " ").lower() in asked or name.lower() in asked][:most]

    def create_metric(self, name: str, expression: str, entity: str) -> Metric:
        guard(self.spark, f"SELECT {expression} AS metric_value FROM {entity}", [*self.tables, *self.views])
        columns = self.spark.table(entity).columns
        if name in columns:
            raise Refused(f"{name} is a column of {entity}")
        self.spark.table(entity).selectExpr(expression)
        self.metrics[name] = Metric(name, expression, entity)
        return self.metrics[name]

    def certified(self, sql: str) -> list[str]:
        """Metrics whose expression is one of the statement's projections and whose entity it reads; none of a statement that
        cannot be read."""
        try:
            shown, entities = set(map(canonical, projected(self.spark, sql))), set(map(str.lower, reads(self.spark, sql)))
        except Refused:
            return []
        return [m.name for m in self.metrics.values() if self._own(m) in shown and m.entity.lower() in entities]

    def _own(self, metric: Metric) -> str:
        return canonical(parser(self.spark).parseExpression(metric.expression))

    def reconcile(self, sql: str, metric: str, shown: DataFrame | None = None) -> Verdict:
        """Computes the metric anew in the statement's own shape and compares its values with those of the answer.

        The statement passes the guard. Its plan stays as it is, with joins, filters, groups, HAVING and limits; the metric's
        own expression is put beside its columns, so that groups named by place or alias hold. shown: the answer's rows as they
        were given, those of a new run if left out. Values are compared as a whole, in any order, without rows coming to
        the driver. No values at all agree with nothing, and what cannot be computed is not reconciled."""
        m = self.metrics[metric]
        guard(self.spark, sql, [*self.tables, *self.views])
        listed = projected(self.spark, sql)
        place = next((k for k, e in enumerate(listed) if canonical(e) == self._own(m)), None)
        if place is None or m.entity.lower() not in map(str.lower, reads(self.spark, sql)):
            return Verdict(False)
        try:
            fresh = with_column(self.spark, parse(self.spark, sql), m.expression, "veritab_metric")
            answer = self.spark.sql(sql) if shown is None else shown
            expected, got = (_values(df, k) for df, k in ((fresh, len(fresh.columns) - 1), (answer, place)))
        except Exception as e:
            return Verdict(True, False, m.name, reason=str(e).splitlines()[0][:200])
        return Verdict(True, expected == got and expected[0] > 0, m.name, *(v[2] for v in (expected, got)))


def _values(df: DataFrame, place: int) -> tuple[int, str, str]:
    """(rows, digest, text) of a column's values; numbers count with nine digits, as sums of doubles depend on their order."""
    column = F.col(f"`{df.columns[place]}`") if df.columns.count(df.columns[place]) == 1 else None
    one = df.select(column.alias("v")) if column is not None else df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(F.col(f"c{place}").alias("v"))
    numeric = one.dtypes[0][1].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    plain = one.select(F.format_string("%.8e", F.col("v").cast("double") + 0.0) if numeric else F.col("v").cast("string")).toDF("v")
    rows, digest = whole_digest(plain)
    text = str(plain.first()["v"]) if rows == 1 else f"{rows} values (digest {digest[:12]})" if rows else ""
    return rows, digest, text


def outer(spark: SparkSession, sql: str):
    """The statement's own SELECT: below its order and limit."""
    plan = parse(spark, sql)
    while name_of(plan) in ("GlobalLimit", "LocalLimit", "Sort", "UnresolvedWith", "UnresolvedHaving", "Offset"):
        plan = next(items(plan.children()))
    return plan


def projected(spark: SparkSession, sql: str) -> list:
    """The expressions of the statement's own columns, without their aliases."""
    plan = outer(spark, sql)
    listed = plan.aggregateExpressions() if name_of(plan) == "Aggregate" else plan.projectList() if name_of(plan) == "Project" else None
    return [] if listed is None else [e.child() if name_of(e) in ("Alias", "UnresolvedAlias") else e for e in items(listed)]


def projections(spark: SparkSession, sql: str) -> list[str]:
    return [text_of(e) for e in projected(spark, sql)]


def filter_and_groups(spark: SparkSession, sql: str) -> tuple[str | None, list[str]]:
    plan = outer(spark, sql)
    groups = [e.sql() for e in items(plan.groupingExpressions())] if name_of(plan) == "Aggregate" else []
    below = next(items(plan.children()), None)
    where = below.condition().sql() if below is not None and name_of(below) == "Filter" else None
    return where, [g.strip("`") for g in groups]


def propose_metric(spark: SparkSession, sql: str) -> tuple[str, str] | None:
    """(expression, entity) of the first aggregate over a single table."""
    found = reads(spark, sql)
    shown = [p for p in projections(spark, sql) if p.lower().startswith(AGGREGATES)]
    return (shown[0], found[0]) if shown and len(found) == 1 else None


def date_buckets(groups: list[str]) -> list[str]:
    """The columns whose months or years a statement groups by."""
    found = [re.search(r"(?i)(?:substr(?:ing)?|date_format|date_trunc|trunc)\(.*?([A-Za-z_][A-Za-z0-9_]*)\b(?:\s+AS\s+\w+\))?\s*(?:,|\))", g) if not g.lower().startswith("date_trunc") else re.search(r"(?i)date_trunc\([^,]*,\s*`?([A-Za-z_][A-Za-z0-9_]*)", g) for g in groups]
    return [m[1] for m in found if m]


def ledger(spark: SparkSession, sql: str, rows: int | None = None) -> list[str]:
    """What a statement assumes, in fixed order: its date column, groups, filter, how nulls count, rows considered, tables."""
    where, groups = filter_and_groups(spark, sql)
    out = []
    if dates := date_buckets(groups):
        out.append(f"Dates are taken from {', '.join(dict.fromkeys(dates))}")
    if groups:
        out.append(f"Grouped by {', '.join(groups)}")
    if where:
        out.append(f"Only rows where {where}")
    if any(p.lower().startswith(AGGREGATES[:5]) for p in projections(spark, sql)):
        out.append("Empty cells are left out of totals and averages")
    if rows is not None:
        out.append(f"{rows:,} rows considered")
    return [*out, f"Reads {', '.join(reads(spark, sql))}"]


def short_id(kind: str, *parts: str) -> str:
    return f"{kind}-{hashlib.sha1(chr(0).join(parts).encode()).hexdigest()[:12]}"


def propose_synonyms(columns: DataFrame, known: DataFrame) -> DataFrame:
    """(term, column_name): for each column of (column_name) that is a usual short form, or long form, the other one; none where both are
    columns or the term has a meaning in known (term)."""
    pairs = [(x, y) for long, short in SHORT_FORMS for x, y in ((long, short), (short, long))]
    forms = columns.sparkSession.createDataFrame(pairs, "column_name string, term string")
    names = columns.select(F.lower("column_name").alias("column_name")).distinct()
    found = names.join(forms, "column_name").join(names.select(F.col("column_name").alias("term")), "term", "left_anti")
    return found.join(known.select(F.lower("term").alias("term")).distinct(), "term", "left_anti").select("term", "column_name")


def closure(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """(name) of all that rests, over any number of steps, on something flagged. edges: (name, reads).

    Only the names that the last step added are followed, until a step adds none, so each step reads the edges once, and a
    cycle ends by itself. Steps are written to the shared folder, which keeps the plan small."""
    folder = new_folder(edges.sparkSession, "closure")
    known = written(edges.select("name", "reads").where("name IS NOT NULL AND reads IS NOT NULL"), f"{folder}/edges")
    new = written(flagged.select("name").where("name IS NOT NULL").distinct(), f"{folder}/0")
    out, step = new, 0
    while not new.isEmpty():
        step += 1
        met = known.join(new.select(F.col("name").alias("reads")), "reads", "left_semi").select("name").distinct()
        new = written(met.join(out, "name", "left_anti"), f"{folder}/{step}")
        out = out.unionAll(new)
    return out


def statement_shape(statement: Column) -> Column:
    """A statement without differences of white space, without case outside of quotes, and with one mark for the names that it
    gives its columns and for the first literal behind its WHERE: statements of one shape aggregate alike."""
    quoted = F.regexp_extract_all(statement, F.lit(r"'(?:[^']|'')*'"), F.lit(0))
    bare = F.split(F.regexp_replace(statement, r"'(?:[^']|'')*'", "\u0001"), "\u0001")
    lower = F.transform(bare, lambda x: F.regexp_replace(F.lower(x), r"\s+", " "))
    whole = F.trim(F.array_join(F.transform(F.arrays_zip(lower.alias("a"), quoted.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), ""))
    # A cast's `as` has a bracket behind its type. Of literals only a filter's own, so that one inside an aggregate stays.
    whole = F.regexp_replace(whole, r"\bas (?:[a-z_][a-z0-9_]*|`[^`]*`) ?(?=,|from )", "as ? ")
    return F.regexp_replace(whole, r"(\bwhere [a-z_][a-z0-9_.]* ?(?:=|<>|!=|<=|>=|<|>) ?)(?:'(?:[^']|'')*'|\d+(?:\.\d+)?)", "$1?")


def mine_metrics(statements: DataFrame, known: Catalog, least: int = RECURRING, shapes: int = SHAPES) -> DataFrame:
    """(expression, entity, n, certified): aggregates over one table that statements (statement, certified) use `least` times, or
    a certified one uses, without those that are metrics already; the most used first.

    Statements are counted by shape where they lie; one example of each shape is parsed, and shapes whose aggregates have
    one tree (names, case, spacing and order of operands aside) count together. More shapes than `shapes` are refused, not
    cut."""
    spark = statements.sparkSession
    counted = statements.where("statement IS NOT NULL").groupBy(statement_shape(F.col("statement")).alias("shape")).agg(F.count("*").alias("n"), F.max(F.coalesce("certified", F.lit(False))).alias("certified"), F.min("statement").alias("example"))
    counted = written(counted, new_folder(spark, "shapes"))
    examples = counted.select("shape", "example").limit(shapes + 1).collect()
    if len(examples) > shapes:
        raise Refused(f"more than {shapes:,} shapes of statements")
    own = {canonical(parser(spark).parseExpression(m.expression), commute=True) for m in known.metrics.values()}
    trees = []
    for r in examples:
        try:
            found = propose_metric(spark, r["example"])
        except Refused:
            continue
        if found and (tree := canonical(parser(spark).parseExpression(found[0]), commute=True)) not in own:
            trees.append((r["shape"], tree, *found))
    read = spark.createDataFrame(trees, "shape string, tree string, expression string, entity string")
    same = counted.join(read, "shape").groupBy("tree", F.lower("entity").alias("entity")).agg(F.min("expression").alias("expression"), F.sum("n").alias("n"), F.max("certified").alias("certified"))
    return same.where(F.col("certified") | (F.col("n") >= least)).select("expression", "entity", "n", "certified").orderBy(F.desc("n"), "expression")


def shaped_samples(before: DataFrame, after: DataFrame, n: int = 3) -> tuple[list, list]:
    """The first rows of a table and of what a statement makes of it."""
    return before.head(n), after.head(n)
