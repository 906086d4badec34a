"""Read-only SQL over known tables with a row cap.

Spark's own parser classifies the statement; only query operators pass. Table
names are checked against the tables given, column names by the analyzer.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

ROW_LIMIT = 500

# Operators of a parsed query that only read.
QUERY_NODES = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving
    UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTableValuedFunction UnresolvedWith Unpivot WithWindowDefinition""".split()
)
# Functions that run code outside the query.
FORBIDDEN_FUNCTIONS = frozenset(["reflect", "java_method", "try_reflect"])


class SqlRejected(ValueError):
    """The statement is not an allowed query."""


@dataclass(frozen=True)
class SqlResult:
    rows: list[dict]
    columns: list[str]
    row_count: int
    truncated: bool


def _items(seq) -> Iterator:
    walk = seq.iterator()
    while walk.hasNext():
        yield walk.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_functions(expressions) -> None:
    for e in expressions:
        if _kind(e) == "UnresolvedFunction":
            name = e.nameParts().mkString(".").lower()
            if name.rpartition(".")[2] in FORBIDDEN_FUNCTIONS:
                raise SqlRejected(f"function {name} is not allowed")
        _check_functions(_items(e.children()))


def _check_plan(node, tables: set[str]) -> None:
    kind = _kind(node)
    if kind not in QUERY_NODES:
        raise SqlRejected(f"only read-only queries are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = node.multipartIdentifier().mkString(".")
        if name.lower() not in tables:
            raise SqlRejected(f"unknown table {name}")
    if kind == "UnresolvedTableValuedFunction" and node.name().mkString(".").lower() != "range":
        raise SqlRejected("table functions other than range are not allowed")
    if kind == "UnresolvedWith":
        # A name defined by WITH is visible to later definitions and the query,
        # not inside its own definition.
        tables = set(tables)
        for entry in _items(node.cteRelations()):
            _check_plan(entry.productElement(1), tables)
            tables.add(entry.productElement(0).lower())
    _check_functions(_items(node.expressions()))
    for part in (node.children(), node.subqueries()):
        for inner in _items(part):
            _check_plan(inner, tables)


def check(spark: SparkSession, sql: str, tables: Collection[str]) -> None:
    """Raise :class:`SqlRejected` unless the text is one query over the tables."""
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as problem:
        raise SqlRejected(f"SQL parse error: {str(problem).splitlines()[0]}") from None
    _check_plan(plan, {t.lower() for t in tables})


def guarded_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The query's result as a lazy frame.

    The tables are views of those names only while the query is analysed.
    """
    check(spark, sql, tables)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql.strip().rstrip(";"))
    except (AnalysisException, ParseException) as problem:
        raise SqlRejected(str(problem).splitlines()[0]) from None
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def run_query(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: int = ROW_LIMIT
) -> SqlResult:
    """At most ``limit`` rows; ``truncated`` is exact because one more row is asked for."""
    from feedloom.sources.warehouse import capped

    df = guarded_query(spark, sql, tables)
    rows, more = capped(df, limit)
    return SqlResult(rows, df.columns, len(rows), more)
