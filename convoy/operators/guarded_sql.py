"""Read-only SQL over the telemetry and quarantine views.

A statement is judged by its parsed plan, not by its words: the plan may hold only the nodes of a
query, read only the two relations, and call only functions of the allow list. Text inside
literals and names of columns are free.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_STATEMENT = "SELECT * FROM telemetry LIMIT 20"
MAX_ROWS = 100
RELATIONS = frozenset({"telemetry", "quarantine", "fleet.telemetry", "fleet.quarantine"})

# What a query over two relations can be made of, by the names of Spark's plan nodes.
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join Union Except Intersect SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedRelation WithWindowDefinition OneRowRelation".split()
)
# Functions of values alone; none reads files, settings or the session, or runs code.
FUNCTIONS = frozenset(
    "abs any_value approx_count_distinct array_agg array_contains avg bool_and bool_or cast ceil ceiling char_length "
    "coalesce concat concat_ws contains corr count count_if date date_add date_diff date_format date_sub date_trunc "
    "datediff day dayofmonth dayofweek dense_rank endswith every exp extract first first_value floor greatest hour if "
    "ifnull initcap instr isnan isnotnull isnull lag last last_value lcase lead least left length like ln locate log "
    "log10 lower lpad ltrim max max_by mean median min min_by minute mod mode month nullif nvl nvl2 percent_rank "
    "percentile percentile_approx pmod position pow power quarter rank regexp_count regexp_extract regexp_replace "
    "replace reverse right round row_number rpad rtrim second sign size split sqrt startswith std stddev stddev_pop "
    "stddev_samp substr substring sum timestamp to_date to_timestamp trim trunc try_divide ucase upper var_pop "
    "var_samp variance weekofyear year".split()
)


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    items = sequence.iterator()
    while items.hasNext():
        yield items.next()


def _nodes(plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """The class name and object of every plan node and expression, subqueries included."""
    todo = [(plan, True)]
    while todo:
        node, is_plan = todo.pop()
        kind = node.getClass().getSimpleName()
        yield ("plan:" if is_plan else "value:") + kind, node
        todo += [(child, is_plan) for child in _items(node.children())]
        if is_plan:
            todo += [(value, False) for value in _items(node.expressions())]
        elif kind in ("ScalarSubquery", "Exists", "ListQuery"):
            todo.append((node.plan(), True))


def refusal(spark: SparkSession, statement: str) -> str | None:
    """Why a statement is refused, or None."""
    if not (statement or "").strip():
        return "empty sql"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as error:
        return f"not one statement: {error.getMessage().splitlines()[0]}"
    read = set()
    for kind, node in _nodes(plan):
        if kind == "plan:UnresolvedRelation":
            name = ".".join(_items(node.multipartIdentifier())).lower()
            if name not in RELATIONS:
                return f"only telemetry and quarantine can be read, not {name}"
            read.add(name)
        elif kind == "value:UnresolvedFunction":
            name = ".".join(_items(node.nameParts())).lower()
            if name not in FUNCTIONS:
                return f"function {name} is not allowed"
        elif kind.startswith("plan:") and kind.removeprefix("plan:") not in NODES:
            return f"only SELECT queries are allowed, not {kind.removeprefix('plan:')}"
    return None if read else "the statement reads neither telemetry nor quarantine"


def register_views(telemetry: DataFrame, quarantine: DataFrame) -> None:
    """Name the two frames a statement may read."""
    telemetry.createOrReplaceTempView("telemetry")
    quarantine.createOrReplaceTempView("quarantine")


def drop_views(spark: SparkSession) -> None:
    for name in ("telemetry", "quarantine"):
        spark.catalog.dropTempView(name)


def query(spark: SparkSession, statement: str = "", limit: int = 50) -> DataFrame:
    """Run a guarded statement over the registered views; an empty one lists telemetry.

    Rows are capped at ``limit`` (1..100) on the result. ``fleet`` is an optional qualifier of both
    relations.
    """
    text = (statement or "").strip().rstrip(";") or DEFAULT_STATEMENT
    reason = refusal(spark, text)
    if reason:
        raise ValueError(reason)
    # Views have no schema; the qualifier goes from the names the parser found, literals stay.
    return spark.sql(_unqualified(spark, text)).limit(max(1, min(limit, MAX_ROWS)))


def _unqualified(spark: SparkSession, text: str) -> str:
    """``text`` without the qualifier ``fleet``, at the places where the plan has such a relation."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    spots = []
    for kind, node in _nodes(plan):
        if kind == "plan:UnresolvedRelation" and node.multipartIdentifier().size() == 2:
            start = node.origin().startIndex()
            if start.isDefined():
                spots.append(start.get())
    for at in sorted(spots, reverse=True):
        dot = text.index(".", at)
        text = text[:at] + text[dot + 1 :]
    return text
