"""Guards around SQL text. What a statement is, Spark's own parser says; texts it can't parse are refused."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Strings, quoted names and comments, or a semicolon, or a parameter.
_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?P<end>;)|\{\{\s*(?P<brace>\w+)\s*\}\}|(?<![:\w]):(?P<colon>[A-Za-z_]\w*)", re.S)
#: Plan nodes of Spark's parser by what they do.
DANGEROUS = {"DropTable": "DROP", "DropView": "DROP", "DropNamespace": "DROP", "DropFunction": "DROP", "TruncateTable": "TRUNCATE", "AddColumns": "ALTER_TABLE", "DropColumns": "ALTER_TABLE", "RenameColumn": "ALTER_TABLE", "RenameTable": "ALTER_TABLE", "AlterColumns": "ALTER_TABLE", "SetTableProperties": "ALTER_TABLE", "ReplaceColumns": "ALTER_TABLE"}
READ_ONLY = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Intersect", "Except", "UnresolvedWith", "UnresolvedHaving", "Join", "SubqueryAlias", "UnresolvedInlineTable", "UnresolvedRelation", "Offset", "WithWindowDefinition", "ShowTables", "ShowNamespaces", "ShowColumns", "ShowCreateTable", "ShowViews", "ShowFunctions", "ShowTablesCommand", "DescribeRelation", "DescribeQueryCommand", "ExplainCommand"}
PAGEABLE = {k for k in READ_ONLY if not k.startswith(("Show", "Describe", "Explain"))}


def split_statements(text: str) -> list[str]:
    """The statements between semicolons that stand outside strings, names and comments."""
    cuts = [m.start() for m in _PART.finditer(text) if m["end"]]
    parts = [text[i:j] for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]
    return [p.strip() for p in parts if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]


def statement_at(text: str, cursor: int) -> str | None:
    """The statement that has the cursor, or else the next, or else the last."""
    at = 0
    found = split_statements(text)
    for s in found:
        at = text.index(s, at) + len(s)
        if cursor <= at:
            return s
    return found[-1] if found else None


def plan_name(spark: SparkSession, statement: str) -> str:
    """The class of the parsed plan's root."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).getClass().getSimpleName()


def danger(spark: SparkSession, statement: str) -> str | None:
    """DROP, TRUNCATE, ALTER_TABLE, DELETE_WITHOUT_WHERE, UPDATE_WITHOUT_WHERE, UNPARSED, or None."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception:  # noqa: BLE001  whatever the parser can't read is not known to be safe
        return "UNPARSED"
    name = plan.getClass().getSimpleName()
    if name == "DeleteFromTable":
        return "DELETE_WITHOUT_WHERE" if plan.condition().toString() == "true" else None
    if name == "UpdateTable":
        return "UPDATE_WITHOUT_WHERE" if plan.condition().isEmpty() else None
    return DANGEROUS.get(name)


def read_only(spark: SparkSession, statement: str) -> bool:
    try:
        return plan_name(spark, statement) in READ_ONLY
    except Exception:  # noqa: BLE001
        return False


def mode(spark: SparkSession, statement: str) -> str:
    """pageable, result (rows, but no pages) or command."""
    name = plan_name(spark, statement)
    return "pageable" if name in PAGEABLE else "result" if name in READ_ONLY else "command"


def parameters(text: str) -> list[str]:
    """Names of :name and {{name}} parameters, in order, each once."""
    return list(dict.fromkeys(m["brace"] or m["colon"] for m in _PART.finditer(text) if m["brace"] or m["colon"]))


def bound(spark: SparkSession, text: str, values: dict) -> DataFrame:
    """The statement with its parameters bound by Spark."""
    return spark.sql(_PART.sub(lambda m: f":{m['brace']}" if m["brace"] else m[0], text), args={k: values[k] for k in parameters(text)})


def single_expression(where: str | None) -> str | None:
    """A filter text: trimmed, none if blank, an error if there is more than one statement in it."""
    found = split_statements(where or "")
    if len(found) > 1 or (found and ";" in _PART.sub(lambda m: ";" if m["end"] else "", found[0])):
        raise ValueError("a filter must be a single SQL expression")
    return found[0] if found else None


def guarded(spark: SparkSession, statement: str, readonly: bool = True, confirmed: bool = False) -> DataFrame:
    """Runs one statement: read-only sessions run nothing else, and dangerous statements need confirmation."""
    found = split_statements(statement)
    if len(found) != 1:
        raise ValueError("one statement is expected")
    if readonly and not read_only(spark, found[0]):
        raise PermissionError("the session is read-only")
    if (what := danger(spark, found[0])) and not confirmed:
        raise PermissionError(f"{what} needs confirmation")
    return spark.sql(found[0])


def explain_nodes(df: DataFrame) -> DataFrame:
    """The optimized plan as rows: id, parent_id, depth, node, and warnings for scans of whole tables."""
    spark, rows = df.sparkSession, []

    def walk(plan, parent: int | None, depth: int) -> None:
        i, name = len(rows), plan.nodeName()
        filtered = parent is not None and "Filter" in (rows[parent][3], rows[rows[parent][1]][3] if rows[parent][1] is not None else "")
        rows.append((i, parent, depth, name, "FULL_TABLE_SCAN" if name.startswith(("Relation", "LogicalRelation")) and not filtered else ""))
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k), i, depth + 1)

    walk(df._jdf.queryExecution().optimizedPlan(), None, 0)
    return spark.createDataFrame(rows, "id int, parent_id int, depth int, node string, warning string")
