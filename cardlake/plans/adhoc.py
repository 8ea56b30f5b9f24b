"""Ad-hoc SQL over the marts, with CSV export."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from cardlake.schemas import GOLD
from cardlake.sinks.exports import export_csv
from cardlake.sources.files import read_csv

# Operators of a query, by the names of the analysed plan's nodes. A query that has any other is refused.
_OPERATORS = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join
    LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sort SubqueryAlias Tail Union Unpivot View Window
    WithCTE WithWindowDefinition""".split()
)
# Packages of the engine's own expressions, and those among them that call the JVM, run foreign code or read where files lie.
_EXPRESSIONS = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis.")
_REFUSED = frozenset(
    """CallMethodViaReflection ScalaUDF ScalaUDAF PythonUDF PythonUDAF PythonUDTF ScalaAggregator InputFileName
    InputFileBlockStart InputFileBlockLength""".split()
)
# Files can't be read by path while a query is analysed.
_STRICT = {"spark.sql.runSQLOnFiles": "false"}


def register_marts(marts: dict[str, DataFrame]) -> None:
    """Make marts visible to SQL under their names."""
    for name, mart in marts.items():
        mart.createOrReplaceTempView(name)


def _items(sequence) -> Iterator:
    """Elements of a Scala sequence."""
    iterator = sequence.iterator()
    while iterator.hasNext():
        yield iterator.next()


def _check_expression(expression, marts: set[str]) -> None:
    """Refuse foreign code and reflection anywhere in an expression; the plans of its subqueries are checked as well."""
    kind, name = expression.getClass().getName(), expression.getClass().getSimpleName()
    if not kind.startswith(_EXPRESSIONS) or name in _REFUSED:
        raise ValueError(f"not allowed in a query: {expression.prettyName()}")
    if _is_subquery(expression):
        _check(expression.plan(), marts)
    for child in _items(expression.children()):
        _check_expression(child, marts)


def _is_subquery(expression) -> bool:
    kind = expression.getClass()
    while kind is not None:
        if kind.getName() == "org.apache.spark.sql.catalyst.expressions.SubqueryExpression":
            return True
        kind = kind.getSuperclass()
    return False


def _check(node, marts: set[str]) -> None:
    """Refuse every operator of an analysed plan that is not known to be harmless, and every view that is no mart."""
    name = node.getClass().getSimpleName()
    if name not in _OPERATORS:
        raise ValueError(f"only the marts can be read, not {node.nodeName()}: {node.simpleString(25)[:80]}")
    if name == "View":
        view = node.desc().identifier()
        if view.database().isDefined() or view.table().lower() not in marts:
            raise ValueError(f"not a mart: {view.unquotedString()}")
        return  # what a mart is made of
    for expression in _items(node.expressions()):
        _check_expression(expression, marts)
    for child in _items(node.children()):
        _check(child, marts)
    # Common table expressions are beside the children.
    for child in _items(node.innerChildren()):
        if child.getClass().getSimpleName() in ("CTERelationDef",):
            _check(child, marts)


def run_query(spark: SparkSession, text: str, marts: Iterable[str] = GOLD) -> DataFrame:
    """Result of one query over the named marts.

    The text is used as a subquery, so statements that change data or definitions do not parse. The analysed plan
    may hold known operators and the engine's own functions only: other tables and views, files by path, user-defined
    functions and functions that call the JVM are refused before anything runs.
    Result columns need distinct names, else they could not be told apart in the export.
    """
    query = (text or "").strip().rstrip(";").strip()
    if not query:
        raise ValueError("missing SQL query")
    before = {key: spark.conf.get(key) for key in _STRICT}
    try:
        for key, value in _STRICT.items():
            spark.conf.set(key, value)
        result = spark.sql(f"SELECT * FROM (\n{query}\n) AS q")
        _check(result._jdf.queryExecution().analyzed(), {name.lower() for name in marts})
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    names = [name.lower() for name in result.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"repeated result columns: {', '.join(repeated)}")
    return result


def run_and_export(spark: SparkSession, text: str, folder: str, marts: Iterable[str] = GOLD) -> tuple[DataFrame, str]:
    """Run one query and store its result as CSV below ``folder``; returns the export as a frame, and its path.

    The query runs once; the frame reads the export, with the result's types.
    """
    result = run_query(spark, text, marts)
    path = export_csv(result, folder)
    return read_csv(spark, path, result.schema, multiline=True), path
