"""The read-only guard over Spark's own parser, and what a statement reads.

The parsed plan's nodes must all be on a list of those that only read; a relation is a one-part name that the caller has
registered, or a CTE within its own scope. Only Spark's own functions may be called, but for those that run foreign code or
tell of files; a function that the session has added is refused, and so is one that hides a function of Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

ALLOWED = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join Union Intersect Except Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable "
    "OneRowRelation UnresolvedWith CTERelationDef UnresolvedHaving WithWindowDefinition Window LateralJoin Generate Pivot UnresolvedPivot Unpivot UnpivotTransformer LocalRelation "
    "ResolvedInlineTable UnresolvedOrdinal Tail Deduplicate LogicalQueryStage".split()
)
REFUSED_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length read_files current_user session_user user".split())


class Refused(ValueError):
    """A statement that is not a single read of registered tables."""


def parser(spark: SparkSession):
    """Spark's SQL parser. This and `builtin` need a classic session."""
    return spark._jsparkSession.sessionState().sqlParser()


def parse(spark: SparkSession, sql: str):
    try:
        return parser(spark).parsePlan(sql)
    except Exception as e:
        raise Refused(f"not one readable statement: {str(e).splitlines()[0][:200]}") from None


def items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def name_of(node) -> str:
    return node.getClass().getSimpleName()


def walk(plan) -> Iterator[tuple[str, object]]:
    """(kind, node) of each plan and expression node, subqueries and CTEs included."""
    yield "plan", plan
    if name_of(plan) == "UnresolvedWith":
        for pair in items(plan.cteRelations()):
            yield from walk(pair._2())
    for expression in items(plan.expressions()):
        yield from walk_expression(expression)
    for child in items(plan.children()):
        yield from walk(child)


def walk_expression(expression) -> Iterator[tuple[str, object]]:
    yield "expression", expression
    if name_of(expression) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        yield from walk(expression.plan())
    for child in items(expression.children()):
        yield from walk_expression(child)


def relations(plan, own: frozenset[str] = frozenset()) -> Iterator[str]:
    """The names of relations below a plan that are no CTE where they stand. A CTE is known to the CTEs after it, to its own
    statement and to the subqueries in it, and nowhere else."""
    kind = name_of(plan)
    if kind == "UnresolvedWith":
        for pair in items(plan.cteRelations()):
            name = pair._1().lower()
            yield from relations(pair._2(), own | {name} if plan.allowRecursion() else own)
            own = own | {name}
    elif kind == "UnresolvedRelation":
        parts = list(items(plan.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in own:
            yield ".".join(parts)
    for expression in items(plan.expressions()):
        yield from _relations_of(expression, own)
    for child in items(plan.children()):
        yield from relations(child, own)


def _relations_of(expression, own: frozenset[str]) -> Iterator[str]:
    if name_of(expression) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        yield from relations(expression.plan(), own)
    for child in items(expression.children()):
        yield from _relations_of(child, own)


def reads(spark: SparkSession, sql: str) -> list[str]:
    """The relations that a statement names, in order of appearance, without its own CTEs."""
    return list(dict.fromkeys(relations(parse(spark, sql))))


def builtin(spark: SparkSession, name: str) -> bool:
    """Whether a name is a function of Spark's own that the session has not replaced."""
    if "." in name or name in REFUSED_FUNCTIONS:
        return False
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.isDefined() and found.get().getSource() == "built-in"


def called(node) -> str | None:
    """The name of the function that an unresolved call names, in full."""
    kind = name_of(node)
    if kind == "UnresolvedFunction":
        return ".".join(items(node.nameParts())).lower()
    return node.name().unquotedString().lower() if kind == "UnresolvedGenerator" else None


def guard(spark: SparkSession, sql: str, tables: list[str] | None = None) -> list[str]:
    """Raises Refused unless the statement only reads registered tables; returns their names."""
    for kind, node in walk(parse(spark, sql)):
        name = name_of(node)
        if kind == "plan" and name not in ALLOWED:
            raise Refused(f"{name} is not a read")
        if kind == "expression" and (function := called(node)) and not builtin(spark, function):
            raise Refused(f"function {function} is not allowed")
    found = reads(spark, sql)
    known = {t.lower() for t in tables} if tables is not None else None
    for name in found:
        if "." in name or known is not None and name.lower() not in known:
            raise Refused(f"{name} is not a registered table")
    return found
