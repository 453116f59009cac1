"""Scalar functions of names, literals, cells and observed values, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_name(c: Column) -> Column:
    """Trimmed, lower case, white space as one underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def physical_name(c: Column, fallback: str = "unnamed") -> Column:
    """A lower-case identifier: camel boundaries and other characters become single underscores, a leading digit gets t_."""
    x = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    x = F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"))
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")
    x = F.when(F.coalesce(x, F.lit("")) == "", F.lit(fallback)).otherwise(x)
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("t_"), x)).otherwise(x)


def is_valid_name(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$")


def is_safe_identifier(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_]+$")


def token_normalize(c: Column) -> Column:
    """Ideographic spaces and runs of white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "　", " "), r"\s+", " ")))


def constant_name(c: Column) -> Column:
    """Upper case, other characters as single underscores; a leading digit gets one before it, nothing is UNKNOWN."""
    x = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).when(x == "", F.lit("UNKNOWN")).otherwise(x)


def class_name(c: Column) -> Column:
    """Words between blanks, underscores, hyphens and dots, each with a large first letter and otherwise as it is."""
    words = F.filter(F.split(F.trim(c), "[ _.-]+"), lambda w: w != "")
    x = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), "")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).when(x == "", F.lit("UnknownEnum")).otherwise(x)


def short_hash(c: Column) -> Column:
    """The first six hex digits of the 32-bit FNV-1a hash of the UTF-8 bytes."""
    step = lambda h, x: ((h.bitwiseXOR(F.conv(x, 16, 10).cast("long"))) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = F.filter(F.split(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "$1 "), " "), lambda x: x != "")
    return F.substring(F.lpad(F.lower(F.hex(F.aggregate(pairs, F.lit(2166136261).cast("long"), step))), 8, "0"), 1, 6)


def clamp_name(c: Column, most: int) -> Column:
    """Names over ``most`` characters are cut and end in the hash of the whole."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 7), F.lit("_"), short_hash(c))).otherwise(c)


def plain_number(c: Column) -> Column:
    """A double as text the way scripts print numbers: 5 for 5.0, no exponent from 1e-6 up to 1e21."""
    fixed = F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when((F.abs(c) < 1e21) & ((F.abs(c) >= 1e-6) | (c == 0)), F.coalesce(fixed, c.cast("string"))).otherwise(c.cast("string"))


def sql_literal(c: Column, kind: str = "string", backslashes: bool = False) -> Column:
    """A value as an SQL literal, by its Spark type: null and numbers that aren't finite as NULL, numbers and booleans as they
    are, all else as text with quotes doubled, and backslashes too where the dialect takes them for escapes."""
    if kind == "boolean":
        return F.coalesce(F.upper(c.cast("string")), F.lit("NULL"))
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit("NULL")).otherwise(plain_number(c.cast("double")))
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.coalesce(c.cast("string"), F.lit("NULL"))
    x = F.replace(c.cast("string"), F.lit("'"), F.lit("''"))
    if backslashes:
        x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), x, F.lit("'")))


def literals(df: DataFrame, columns: list[str], backslashes: bool = False) -> dict[str, Column]:
    """The literal of each column, by the column's type."""
    kinds = dict(df.dtypes)
    return {c: sql_literal(F.col(c), kinds[c], backslashes) for c in columns}


def csv_cell(c: Column, delimiter: str = ",", also: str = "") -> Column:
    """A CSV cell: empty for null, quoted where it has the delimiter, a quote, a line feed or a character of ``also``."""
    x = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(reduce(or_, (x.contains(m) for m in [delimiter, '"', "\n", *also])), quoted).otherwise(x)


def csv_line(df: DataFrame, columns: list[str], delimiter: str = ",") -> Column:
    """A row as a line for clients: carriage returns are quoted too, booleans are true and false, 5.0 is 5."""
    kinds = dict(df.dtypes)
    cell = lambda c: plain_number(F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c)
    return F.concat_ws(delimiter, *(csv_cell(cell(c), delimiter, "\r") for c in columns))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


#: Kinds of CSV cells, and kinds of observed texts, with their patterns in the order in which they are tried.
CELL_KINDS = [
    ("integer", r"^-?[0-9]+$"),
    ("decimal", r"^-?[0-9]+\.[0-9]+$"),
    ("boolean", r"^(?i)(true|false)$"),
    ("datetime", r"^(?i)[0-9]{4}-[0-9]{2}-[0-9]{2}([ t][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(z|[+-][0-9]{2}:?[0-9]{2})?)?$"),
]
VALUE_KINDS = [
    ("uuid-like", r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"),
    ("email-like", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    ("timestamp-like", r"^(?i)[0-9]{4}-[0-9]{2}-[0-9]{2}([ t][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(z|[+-][0-9]{2}:[0-9]{2})?)?$"),
    ("json-like", r"^(?s)[\[{].*[\]}]$"),
    ("integer-like", r"^-?[0-9]+$"),
    ("number-like", r"^-?[0-9]+\.[0-9]+$"),
    ("long-text", r"^(?s).{49,}$"),
]


def kind_of(c: Column, kinds: list[tuple[str, str]], blank: str, other: str = "text") -> Column:
    """The first kind whose pattern the trimmed text has."""
    x = F.trim(c.cast("string"))
    start = F.when(x.isNull() | (x == ""), F.lit(blank))
    return reduce(lambda w, k: w.when(x.rlike(k[1]), F.lit(k[0])), kinds, start).otherwise(F.lit(other))


def observed_kind(c: Column, kind: str = "string") -> Column:
    """The kind of an observed value, by the Spark type of its column; texts by their patterns."""
    if kind == "boolean":
        found = F.lit("boolean")
    elif kind in ("double", "float") or kind.startswith("decimal"):
        found = F.when(c == F.floor(c), "integer").otherwise("number")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        found = F.lit("integer")
    else:
        found = kind_of(c, VALUE_KINDS, "empty-text")
    return F.when(c.isNull(), "null").otherwise(found)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sql_pattern(c: Column) -> Column:
    """A statement on one line with its literals, and what stands in quotes of any kind, as question marks."""
    x = one_line(c)
    for literal in (r"'([^']|'')*'", r'"([^"]|"")*"', r"`[^`]*`", r"\b[0-9]+(?:\.[0-9]+)?\b", r"(?i)\btrue\b|\bfalse\b|null\b"):
        x = F.regexp_replace(x, literal, "?")
    return F.trim(x)


def statement_kind(c: Column) -> Column:
    """select, insert, update, delete or unknown, by the first word after blanks and comments."""
    x = F.lower(F.regexp_replace(c, r"^(\s|--[^\n]*\n?|/\*(?s:.*?)\*/)+", ""))
    found = F.when(x.startswith("select ") | x.startswith("with "), "select")
    return reduce(lambda w, k: w.when(x.startswith(f"{k} "), k), ("insert", "update", "delete"), found).otherwise("unknown")


def shortened(c: Column, most: int = 88) -> Column:
    """On one line; longer ones are cut so that the dots still fit."""
    x = one_line(c)
    cut = F.concat(F.rtrim(F.substring(x, 1, max(0, most - 3))), F.lit("..."))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("(empty SQL)")).when(F.length(x) <= most, x).otherwise(cut)


def comment_meaning(c: Column) -> Column:
    """A comment without what formatting alone changes: line endings, blanks around lines, blank lines."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


#: What parts the words of a name in searches.
SEPARATORS = r"[\s_\-./\\]+"


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility forms (full width, half width, circled, ligatures) as what they stand for, composed. ASCII stays in the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_compatible(c))


def search_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), SEPARATORS, "")


def search_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SEPARATORS), lambda w: w != "")


def allowed_edits(query: str) -> int:
    """Edits that a query of so many characters may be off by."""
    return next((edits for most, edits in ((4, 1), (7, 3), (10, 4)) if len(query) <= most), 5)


def fuzzy_match(c: Column, query: str) -> Column:
    """If a name has the query in it, as a part, as a subsequence (from three characters on), or within the allowed edits of one
    of its words or of its beginning. Case, separators and compatibility forms have no meaning."""
    q = re.sub(SEPARATORS, "", unicodedata.normalize("NFKC", query).lower())
    if not q:
        return F.lit(True)
    c = nfkc(c)
    name, tokens = search_key(c), search_tokens(c)
    within = ".*".join(map(re.escape, q)) if len(q) >= 3 else None
    near = lambda x: F.levenshtein(x, F.lit(q)) <= allowed_edits(q)
    hits = [name.contains(q), F.exists(tokens, lambda t: t.contains(q) | near(t)), near(F.substring(name, 1, len(q)))]
    if within:
        hits += [name.rlike(within), F.exists(tokens, lambda t: t.rlike(within))]
    return (F.coalesce(name, F.lit("")) != "") & reduce(or_, hits)


def show_whitespace(c: Column) -> Column:
    """Blanks, ideographic spaces and tabs as marks that can be seen."""
    return F.translate(c, " \u3000\t", "\u00b7\u25a1\u21e5")


def natural_key(c: Column) -> Column:
    """A key whose order is that of people: numbers in a name by their value, letters whatever their case."""
    runs = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 30, "0")).otherwise(F.lower(x))), "")


def bigrams(c: Column) -> Column:
    """The pairs of neighbouring characters; the text itself if it has one character. The text is split once, as a substring is looked
    for from the start."""
    n = F.length(c)
    pairs = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.concat(F.get(s, i), F.get(s, i + 1)))
    return F.when(n <= 1, F.filter(F.array(c), lambda x: x != "")).otherwise(let(F.split(c, ""), pairs))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _runs(found: Column, use) -> Column:
    """``use`` of each run of equal elements of the sorted array: the elements, where the run starts and where it ends."""
    def runs(t: Column) -> Column:
        s, n = t["s"], F.size(t["s"])
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (n > 0) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        ends = lambda u: F.concat(F.slice(u, 2, F.greatest(F.size(u) - 1, F.lit(0))), F.filter(F.array(n), lambda x: x > 0))
        return let(starts, lambda u: F.zip_with(u, ends(u), lambda i, j: use(s, i, j)))

    return let(F.struct(F.array_sort(found).alias("s")), runs)


def counted(found: Column) -> Column:
    """Elements told apart by occurrence, so that set functions count like those of multisets. Equal elements stand side by side once
    sorted, so each run of them is numbered from where it starts: the work grows with the elements, not with their square."""
    return F.flatten(_runs(found, lambda s, i, j: F.transform(F.sequence(i, j - 1), lambda k: F.concat_ws("\u0001", F.get(s, k), (k - i - 1).cast("string")))))


def gram_counts(c: Column) -> Column:
    """The bigrams of a normalised name with how often each occurs (x and n), in order; an empty name has an empty one."""
    x = normalize_name(F.coalesce(c, F.lit("")))
    return F.when(x == "", F.array(F.struct(F.lit("").alias("x"), F.lit(1).alias("n")))).otherwise(_runs(bigrams(x), lambda s, i, j: F.struct(F.get(s, i).alias("x"), (j - i).alias("n"))))


def counts_dice(a: Column, b: Column) -> Column:
    """``dice`` of two names by their ``gram_counts``, for names that are compared with many others."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda t, g: t + g["n"])
    # a gram stands in the other beside itself once both are sorted together
    met = lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0), lambda t, i: t + F.when(F.get(s, i)["x"] == F.get(s, i - 1)["x"], F.least(F.get(s, i)["n"], F.get(s, i - 1)["n"])).otherwise(0))
    return 2.0 * let(F.array_sort(F.concat(a, b)), met) / (total(a) + total(b))


def dice(a: Column, b: Column) -> Column:
    """Similarity by bigrams counted with their multiplicity; 1 for equal texts, 0 if one of them is empty."""
    names = F.struct(normalize_name(F.coalesce(a, F.lit(""))).alias("a"), normalize_name(F.coalesce(b, F.lit(""))).alias("b"))
    grams = lambda t: F.struct(counted(bigrams(t["a"])).alias("x"), counted(bigrams(t["b"])).alias("y"))
    shared = lambda g: 2.0 * F.size(F.array_intersect(g["x"], g["y"])) / (F.size(g["x"]) + F.size(g["y"]))
    return let(names, lambda t: F.when(t["a"] == t["b"], 1.0).when((t["a"] == "") | (t["b"] == ""), 0.0).otherwise(let(grams(t), shared)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
