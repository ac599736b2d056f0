"""A guarded SELECT dialect: checks on Spark's own parse of a query, dialect rewriting, and scoped tables that fail closed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Verbs that a query must not hold; table-level limits of the dialect (columns, conditions, joins, rows).
FORBIDDEN = ("DROP", "DELETE", "INSERT", "UPDATE", "TRUNCATE", "ALTER", "CREATE", "EXEC", "EXECUTE", "MERGE", "REPLACE", "GRANT", "REVOKE", "CALL", "LOAD", "RENAME")
MOST_JOINS, MOST_ROWS = 4, 300
#: What a parsed query may consist of; any other node of a plan is refused.
PLAIN_NODES = {"Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "SubqueryAlias", "UnresolvedRelation", "OneRowRelation", "Distinct"}
#: What its expressions may consist of, beside functions of FUNCTIONS.
PLAIN_EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedOrdinal", "Alias", "Literal", "SortOrder", "UnresolvedFunction", "And", "Or", "Not", "EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Between", "UnresolvedBetweenExpression", "In", "InSubquery",
    "IsNull", "IsNotNull", "Like", "ILike", "LikeAny", "LikeAll", "NotLikeAny", "NotLikeAll", "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "CaseWhen", "Cast", "Extract", "ScalarSubquery", "Exists", "ListQuery", "MultiAlias",
    "StringTrim", "StringTrimLeft", "StringTrimRight", "Substring", "StringInstr", "StringLocate", "CurrentDate", "CurrentTimestamp", "Now", "Concat",
}
#: Plain functions of values and groups: none reads files, settings or the session, runs code, or fails on purpose.
FUNCTIONS = {
    "count", "count_if", "sum", "avg", "mean", "min", "max", "min_by", "max_by", "median", "mode", "stddev", "variance", "any_value", "first", "last", "approx_count_distinct", "percentile", "collect_list", "collect_set", "bool_and", "bool_or",
    "abs", "ceil", "ceiling", "floor", "round", "bround", "sign", "sqrt", "power", "pow", "exp", "ln", "log", "log10", "log2", "mod", "pmod", "greatest", "least", "radians", "degrees", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "pi",
    "upper", "lower", "ucase", "lcase", "initcap", "trim", "ltrim", "rtrim", "length", "char_length", "character_length", "len", "concat", "concat_ws", "substring", "substr", "left", "right", "replace", "reverse", "lpad", "rpad", "instr", "locate", "position", "split_part", "translate", "contains", "startswith", "endswith", "like", "ilike",
    "between", "coalesce", "ifnull", "nvl", "nvl2", "nullif", "if", "iff", "isnull", "isnotnull", "cast", "string", "int", "bigint", "double", "date", "timestamp",
    "year", "quarter", "month", "day", "dayofmonth", "dayofweek", "dayofyear", "weekofyear", "weekday", "hour", "minute", "second", "date_format", "to_date", "to_timestamp", "date_trunc", "trunc", "date_add", "date_sub", "dateadd", "datediff", "date_diff", "months_between", "add_months", "last_day", "next_day", "extract", "date_part", "current_date", "current_timestamp", "now", "make_date",
}
#: Names that stand for the session where no column has them; a column of such a name must be written with its table's.
SESSION_NAMES = {"user", "current_user", "session_user", "current_catalog", "current_database", "current_schema", "current_path", "system_user"}
_STRING = r"'(?:[^']|'')*'"


class UnsafeSql(ValueError):
    pass


def _bare(sql: str) -> str:
    """Upper case, without strings and comments."""
    out = re.sub(_STRING, "''", sql)
    return re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", out), flags=re.S).upper()


def _walk(plan, expressions: list):
    """All nodes of a parsed plan, those of subqueries in expressions too; every expression is put into ``expressions``."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += [node.children().apply(i) for i in range(node.children().size())]
        inner = [node.expressions().apply(i) for i in range(node.expressions().size())]
        while inner:
            e = inner.pop()
            expressions.append(e)
            if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                todo.append(e.plan())
            inner += [e.children().apply(i) for i in range(e.children().size())]


def validate(spark: SparkSession, sql: str, tables: Iterable[str]) -> None:
    """Raise UnsafeSql unless the text (in the dialect) is one SELECT over tables of the whitelist (names in any case).

    The whitelist is held against the relations of the plan that Spark's parser makes of the query: quoted names, paths
    of files, names with a catalog, comma joins, common table expressions and table functions are all refused. So is every kind of
    expression that isn't in PLAIN_EXPRESSIONS and every function that isn't in FUNCTIONS, whose names have one part."""
    bare = _bare(sql)
    if not re.match(r"\s*SELECT\b", bare):
        raise UnsafeSql("only SELECT is allowed")
    if ";" in bare:
        raise UnsafeSql("several statements")
    if found := next((w for w in FORBIDDEN if re.search(rf"\b{w}\b", bare)), None):
        raise UnsafeSql(f"{found} is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(to_spark(sql))
        expressions: list = []
        nodes = list(_walk(plan, expressions))
    except Exception as e:
        raise UnsafeSql("not a SELECT that can be read") from e
    allowed, joins = {t.upper() for t in tables}, 0
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if kind not in PLAIN_NODES:
            raise UnsafeSql(f"{kind} is not allowed")
        if kind == "Join":
            joins += 1
            if node.condition().isEmpty():
                raise UnsafeSql("tables must be joined explicitly, on a condition")
        if kind == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            if len(parts) != 1 or parts[0].upper() not in allowed:
                raise UnsafeSql(f"table {'.'.join(parts)} is not known")
    for e in expressions:
        kind = e.getClass().getSimpleName()
        if kind not in PLAIN_EXPRESSIONS:
            raise UnsafeSql(f"{kind} is not allowed")
        if kind == "UnresolvedAttribute" and e.nameParts().size() == 1 and e.nameParts().apply(0).lower() in SESSION_NAMES:
            raise UnsafeSql(f"{e.nameParts().apply(0)} is not allowed")
        if kind == "UnresolvedFunction":
            name = [e.nameParts().apply(i) for i in range(e.nameParts().size())]
            if len(name) != 1 or name[0].lower() not in FUNCTIONS:
                raise UnsafeSql(f"the function {'.'.join(name)} is not allowed")
    if joins > MOST_JOINS:
        raise UnsafeSql(f"more than {MOST_JOINS} joins")


def to_spark(sql: str, default_limit: int | None = MOST_ROWS) -> str:
    """The dialect in Spark's words: * and ? in LIKE patterns (% and _ are plain there), case-insensitive LIKE, IS as =, LIMIT offset,count."""
    escaped = lambda x: re.sub(r"([%_])", r"\\\1", x.replace("\\", "\\\\\\\\")).replace("*", "%").replace("?", "_")
    out = re.sub(rf"(?i)\bLIKE\s+'((?:[^']|'')*)'", lambda m: f"ILIKE '{escaped(m[1])}'", sql)
    parts = re.split(f"({_STRING})", out)  # what stands in quotes isn't rewritten
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?i)\bIS\s+(?!NOT\b|NULL\b|DISTINCT\b)", "= ", re.sub(r"(?i)\bIS$", "=", parts[i].rstrip()) + parts[i][len(parts[i].rstrip()) :])
        parts[i] = re.sub(r"(?i)\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", parts[i])
    out = "".join(parts)
    return out if default_limit is None or re.search(r"(?i)\bLIMIT\s+\d+", "".join(parts[::2])) else f"{out} LIMIT {default_limit}"


def scoped(tables: Mapping[str, DataFrame], scope: Mapping[str, object] | None, through: Mapping[str, tuple[str, str, str]] | None = None, lookups: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The rows of each table that a scope covers.

    ``scope``: of a column's name, the value that it must have. A table without one of these columns is cut to the rows
    whose own key stands in another, scoped table (``through``: own key, other table, its key). Tables named in
    ``lookups`` hold nothing to protect and stay whole. Any other table has no rows."""
    if not scope:
        return dict(tables)
    done: dict[str, DataFrame] = {}

    def of(name: str, above: tuple[str, ...] = ()) -> DataFrame:
        if name not in done:
            df, missing = tables[name], [c for c in scope if c not in tables[name].columns]
            for column, value in scope.items():
                if column in df.columns:
                    df = df.where(F.col(column) == value)
            if missing and name not in lookups:
                way = (through or {}).get(name)
                if way is None or way[1] in above:
                    df = df.where(F.lit(False))
                else:
                    df = df.join(of(way[1], (*above, name)).select(F.col(way[2]).alias(way[0])).distinct(), way[0], "left_semi")
            done[name] = df
        return done[name]

    return {name: of(name) for name in tables}


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], scope: Mapping[str, object] | None = None, default_limit: int | None = MOST_ROWS, through: Mapping[str, tuple[str, str, str]] | None = None, lookups: Iterable[str] = ()) -> DataFrame:
    """Check a query and run it over the rows in scope (see ``scoped``). Its tables are named for this query alone."""
    validate(spark, sql, tables)
    views = {name: f"gate_{uuid.uuid4().hex}" for name in tables}
    rows = scoped(tables, scope, through, lookups)
    try:
        for name, view in views.items():
            rows[name].createOrReplaceTempView(view)
        own = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {own} {to_spark(sql, default_limit)}")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def employee_scope(employees: DataFrame, ranks: DataFrame, units: DataFrame, unit_types: DataFrame, districts: DataFrame, employee_id: object) -> DataFrame:
    """One row on an employee: rank_hierarchy, unit_id, unit_hierarchy, district_id, each null where the chain breaks; empty for an unknown one.

    employees: employee_id, rank_id, unit_id, district_id; ranks: rank_id, hierarchy; units: unit_id, type_id; unit_types: type_id, level; districts: district_id."""
    one = employees.where(F.col("employee_id").cast("string") == str(employee_id)).limit(1)
    rank = ranks.select("rank_id", F.col("hierarchy").alias("rank_hierarchy"))
    unit = units.select("unit_id", F.col("unit_id").alias("known_unit"), "type_id").join(unit_types.select("type_id", F.col("level").alias("unit_hierarchy")), "type_id", "left").drop("type_id")
    full = one.join(rank, "rank_id", "left").join(unit, "unit_id", "left").join(districts.select("district_id", F.col("district_id").alias("known_district")), "district_id", "left")
    return full.select("employee_id", "rank_hierarchy", F.col("known_unit").alias("unit_id"), "unit_hierarchy", F.col("known_district").alias("district_id"))


def column_meta(rows: DataFrame) -> list[dict[str, str]]:
    """Name, type and a plain title of each column of a result."""
    return [{"name": c, "type": t, "title": re.sub(r"(?<=[a-z])(?=[A-Z])|_", " ", c).strip()} for c, t in rows.dtypes]


def source_refs(rows: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """(table, id): the distinct records that a result's key columns (column: table) point to."""
    parts = [rows.where(F.col(c).isNotNull()).select(F.lit(t).alias("table"), F.col(c).cast("string").alias("id")) for c, t in keys.items() if c in rows.columns]
    out = rows.sparkSession.createDataFrame([], "table string, id string")
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def without_aliases(sql: str) -> str:
    """The query without the names that AS gives to its columns; names of tables stay."""
    head, rest = re.split(r"(?i)(?=\bFROM\b)", sql, maxsplit=1) if re.search(r"(?i)\bFROM\b", sql) else (sql, "")
    return re.sub(r"(?i)\s+AS\s+(?:`[^`]*`|\w+)", "", head) + rest


def answer(rows: DataFrame) -> str:
    """One row with one value: the value; else how many rows were found. One job, over one more row than the dialect returns."""
    first = rows.limit(MOST_ROWS + 1).collect()
    return f"Result: {first[0][0]}" if len(first) == 1 and len(rows.columns) == 1 else f"Found {len(first) if len(first) <= MOST_ROWS else rows.count()} record(s)."


def templated_answer(rows: DataFrame, label: str = "label", value: str = "value") -> str:
    """A sentence on a result of labels and values: total, the largest, and how the last compares with the first."""
    found = rows.agg(F.sum(value).alias("total"), F.max_by(label, F.struct(value, label)).alias("top"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not found["n"]:
        return "No records found."
    return f"{found['total']} in total over {found['n']} groups; most: {found['top']} ({found['most']})."
