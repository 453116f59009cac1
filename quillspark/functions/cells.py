"""Cells that users type or import: typed values, timestamps, characters that can't be seen, type names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text

#: Labels of characters that have no shape.
INVISIBLE = {0x00A0: "NBSP", 0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x2060: "WJ", 0xFEFF: "BOM"}
CONTROLS = r"[\x00-\x1F\x7F-\x9F]"
#: What counts as a number in a cell.
NUMBER = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|[+-]?Infinity)$"

#: Column types by kind of cell, for the two dialects.
KIND_TYPES = {
    "mysql": {"integer": "int", "decimal": "decimal(18,6)", "datetime": "datetime", "boolean": "tinyint(1)"},
    "postgres": {"integer": "integer", "decimal": "numeric(18,6)", "datetime": "timestamptz", "boolean": "boolean"},
}


def has_invisible(c: Column) -> Column:
    marks = "".join(map(chr, INVISIBLE))
    return F.coalesce(c.rlike(f"[{marks}]") | c.rlike(CONTROLS), F.lit(False))


def show_invisible(c: Column) -> Column:
    """Characters without a shape as their labels in brackets, control characters as their code points."""
    def shown(x: Column) -> Column:
        code = F.concat(F.lit("\u27e6U+"), F.lpad(F.hex(F.ascii(x)), 4, "0"), F.lit("\u27e7"))
        known = reduce(lambda w, k: w.when(x == chr(k[0]), F.lit(f"\u27e6{k[1]}\u27e7")), INVISIBLE.items(), F.when(F.lit(False), F.lit("")))
        return known.when(x.rlike(CONTROLS), code).otherwise(x)

    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), ""), shown), "")


def type_of_kind(kind: Column, length: Column, driver: str = "mysql") -> Column:
    """The column type for a kind of cell; texts by the length of the longest, with a fifth more."""
    width = F.least(F.lit(255), F.ceil(length * F.lit("1.2").cast("decimal(2,1)"))).cast("int").cast("string")
    of_text = F.when(length == 0, "varchar(255)").when(length > 255, "text").otherwise(F.concat(F.lit("varchar("), width, F.lit(")")))
    return reduce(lambda w, k: w.when(kind == k[0], F.lit(k[1])), KIND_TYPES[driver].items(), F.when(F.lit(False), F.lit(""))).otherwise(of_text)


def coerced(cell: Column, kind: Column) -> Column:
    """A CSV cell as a struct of value and quoted, for an INSERT: blanks are null; numbers that print as they are written go
    bare, others as text, so that no digit is lost; booleans are TRUE and FALSE; texts stay whole."""
    x = F.trim(cell)
    whole = x.rlike("^(0|-?[1-9][0-9]{0,15})$") & (F.abs(x.try_cast("decimal(38,0)")) <= 9007199254740991)
    exact = whole | (x.rlike(r"^-?(0|[1-9][0-9]{0,14})\.[0-9]*[1-9]$") & (F.length(F.regexp_replace(x, "[-.]|^-?0\\.0*", "")) <= 15))
    made = lambda value, quoted: F.struct(value.alias("value"), F.lit(quoted).alias("quoted"))
    return (
        F.when(F.coalesce(x, F.lit("")) == "", made(F.lit(None).cast("string"), False))
        .when((kind == "integer") & whole | (kind == "decimal") & exact, made(x, False))
        .when((kind == "boolean") & x.rlike("^(?i)(true|false)$"), made(F.upper(x), False))
        .when(kind.isin("integer", "decimal", "boolean"), made(x, True))
        .otherwise(made(cell, True))
    )


def inserted(cell: Column) -> Column:
    """What is typed into a new row, as a struct of type (unset, null, boolean, number or text) and value."""
    x = F.trim(cell)
    made = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    return (
        F.when(F.coalesce(x, F.lit("")) == "", made("unset", F.lit(None)))
        .when(F.lower(x) == "null", made("null", F.lit(None)))
        .when(F.lower(x).isin("true", "false"), made("boolean", F.lower(x)))
        .when(x.isin("\"\"", "''"), made("text", F.lit("")))
        .when(x.rlike(NUMBER), made("number", x))
        .otherwise(made("text", cell))
    )


def edited(raw: Column, original: Column, kind: str) -> Column:
    """What a typed-over cell becomes, as text, by the type of the loaded value: nothing typed over null stays null, booleans are
    true for true, 1 and yes, and text that is no number stays text in a number column."""
    x = F.trim(raw)
    if kind == "boolean":
        typed = F.lower(x).isin("true", "1", "yes").cast("string")
    elif kind in ("tinyint", "smallint", "int", "bigint", "double", "float") or kind.startswith("decimal"):
        typed = F.when(x == "", F.lit("0")).when(x.rlike(NUMBER), F.coalesce(text.plain_number(x.try_cast("double")), x)).otherwise(raw)
    else:
        typed = raw
    return F.when(original.isNull(), F.when(raw != "", raw)).otherwise(typed)


def timestamp_ms(c: Column) -> Column:
    """Milliseconds of a timestamp: date and time with a blank between are UTC, RFC 3339 says its zone, all else is 0."""
    plain = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    x = F.when(plain, F.concat(F.translate(c, " ", "T"), F.lit("Z"))).when(c.rlike(r"^(?i)[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(z|[+-][0-9]{2}:[0-9]{2})$"), F.upper(c))
    return F.coalesce(F.unix_millis(F.try_to_timestamp(F.translate(x, " ", "T"))), F.lit(0).cast("long"))


def type_and_size(data_type: Column, size: Column) -> Column:
    """A struct of type (lower case, null if blank) and size; a size in brackets counts where there is no other."""
    raw = F.translate(F.trim(F.coalesce(data_type, F.lit(""))), "\uff08\uff09\uff0c", "(),")
    given = F.nullif(F.trim(F.coalesce(size, F.lit(""))), F.lit(""))
    inline = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(raw, r"^[^(]*\((?s)(.*)$", 1), r"\)+$", "")), F.lit(""))
    base = F.nullif(F.lower(F.trim(F.regexp_extract(raw, r"^[^(]*", 0))), F.lit(""))
    return F.struct(F.when(raw != "", F.coalesce(base, F.lit(""))).alias("type"), F.coalesce(given, F.when(raw != "", inline)).alias("size"))


def _sized(name: Column, size: Column) -> Column:
    return F.when(size.isNull(), name).otherwise(F.concat(name, F.lit("("), size, F.lit(")")))


INTEGERS = ["tinyint", "smallint", "int", "integer", "bigint"]


def mysql_type(typed: Column, upper: bool = False, booleans: bool = False, charset: str = "utf8mb4", collate: str = "utf8mb4_bin") -> Column:
    """A struct of ``type_and_size`` as a MySQL column type."""
    t, size = F.coalesce(typed["type"], F.lit("varchar")), typed["size"]
    token = F.upper if upper else F.lower
    named = lambda x: token(F.lit(x))
    return (
        F.when(t.isin("varchar", "char"), F.concat(_sized(token(t), F.coalesce(size, F.lit("255"))), F.lit(f" CHARACTER SET {charset} COLLATE {collate}")))
        .when(t.isin(INTEGERS), _sized(token(F.when(t == "integer", "int").otherwise(t)), size))
        .when(t.isin("date", "longtext", "mediumtext", "blob", "json"), token(t))
        .when(t.isin("decimal", "numeric"), _sized(named("decimal"), F.coalesce(size, F.lit("10,2"))))
        .when(t.isin("boolean", "bool"), named("boolean") if booleans else _sized(named("tinyint"), F.lit("1")))
        .otherwise(_sized(token(t), size))
    )


def oracle_type(typed: Column) -> Column:
    """A struct of ``type_and_size`` as an Oracle column type."""
    t, size = F.coalesce(typed["type"], F.lit("varchar")), typed["size"]
    or_else = lambda x: F.coalesce(size, F.lit(x))
    return (
        F.when(t == "varchar", _sized(F.lit("VARCHAR2"), or_else("255")))
        .when(t == "char", _sized(F.lit("CHAR"), or_else("1")))
        .when(t.isin(INTEGERS), _sized(F.lit("NUMBER"), size))
        .when(t == "date", F.lit("DATE"))
        .when(t.isin("datetime", "timestamp"), _sized(F.lit("TIMESTAMP"), size))
        .when(t.isin("text", "mediumtext", "longtext", "json"), F.lit("CLOB"))
        .when(t.isin("decimal", "numeric"), _sized(F.lit("NUMBER"), or_else("10,2")))
        .when(t == "float", _sized(F.lit("FLOAT"), size))
        .when(t == "double", F.lit("BINARY_DOUBLE"))
        .when(t.isin("boolean", "bool"), F.lit("NUMBER(1)"))
        .when(t == "blob", F.lit("BLOB"))
        .otherwise(_sized(F.upper(t), size))
    )
