"""Workbooks as data: cells of .xlsx files as a frame, table definitions from them, and workbooks written from a catalog.

Files are read by Spark's binaryFile source and unpacked within tasks, a file at a time; everything after that is frames.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import or_
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import cells, text

GRID = "path string, sheet_no int, sheet string, row_idx int, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(ref: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_label(n: int) -> str:
    out, n = "", n + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheets_of(data: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, name, row, trimmed cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
            path = targets[sheet.get(_REL)]
            for row in ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}")).iter(f"{_NS}row"):
                cells: list[str] = []
                for c in row:
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t")).strip()
                    elif (v := c.find(f"{_NS}v")) is not None:
                        cells[at] = (shared[int(v.text)] if c.get("t") == "s" else v.text or "").strip()
                yield k, sheet.get("name"), int(row.get("r")) - 1, cells


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row of each sheet of the workbooks under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(name, *row) for row in sheets_of(bytes(data))], columns=["path", "sheet_no", "sheet", "row_idx", "cells"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, GRID)


def write_workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook with inline strings; time stamps are fixed, so equal sheets give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, body: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)

        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        pack = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        each = list(enumerate(sheets, 1))
        put("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in each) + "</Types>")
        put("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in each) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in each) + "</Relationships>")
        for i, name in each:
            rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{column_label(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(row)) + "</row>" for r, row in enumerate(sheets[name], 1))
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


#: Headers of column definitions by what they hold, labels of table names, marks of primary keys, words for and against
#: NOT NULL, and rows that describe the table. All in lower case, with single blanks.
HEADERS = {
    "no": ["no", "no.", "no,", "ｎｏ", "番号"],
    "logical_name": ["論理名"],
    "physical_name": ["物理名"],
    "type": ["データ型", "データタイプ"],
    "size": ["size", "サイズ"],
    "not_null": ["not null", "notnull", "必須"],
    "pk": ["pk", "主キー"],
    "comment": ["備考", "列とコードの説明 / 備考", "コメント"],
}
LOGICAL_TABLE, PHYSICAL_TABLE, TITLE_A, TITLE_B = "論理テーブル名", "物理テーブル名", "テーブル情報", "データベース定義書"
PK_MARKS = ["〇", "○", "◯"]
TRUE = ["1", "true", "yes", "y", "on", "required", *PK_MARKS, "必須"]
FALSE = ["0", "false", "no", "n", "off", "-", "任意"]
ABOUT_TABLE = ["rdbms", "engine", "charset", "作成日 / 作成者", "更新日 / 更新者"]
ABOUT_ENGINE = ["mysql", "innodb", "utf8mb4"]
COUNTS_UP = ["(ai)", "(auto_increment)", "(auto increment)", "(identity)"]
COUNTS_UP_SAID = ["auto increment", "identity", "自動採番", "自動連番", "自增"]
DOES_NOT_COUNT_UP = ["not auto increment", "no auto increment", "非自增", "自動採番なし"]
#: Our own English headers beside them; definition_sheets writes these.
ENGLISH = {"logical_name": ["logical name"], "physical_name": ["physical name"], "type": ["data type", "type"], "size": ["length"], "not_null": ["required"], "pk": ["primary key"], "comment": ["comment"]}
WORDS = {f: [*names, *ENGLISH.get(f, [])] for f, names in HEADERS.items()}
TABLE_NAME = [PHYSICAL_TABLE, "table name", "physical table name"]
#: Rows above a region in which its table's name is looked for, and columns to its left and right.
ABOVE, LEFT, RIGHT = 30, 2, 4


def token(x: Column) -> Column:
    """A cell for comparison: ideographic spaces are blanks, blanks are single, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(x, "\u3000", " "), r"\s+", " ")))


def not_null_flag(x: Column) -> Column:
    t = token(F.coalesce(x, F.lit("")))
    return F.when(t.isin(FALSE), False).when(t.isin(TRUE), True).otherwise(t.contains("not null"))


def counts_up(type_: Column, comment: Column) -> Column:
    """If a type ends in a mark of an identity column, or the comment says so and doesn't deny it."""
    said = lambda words: reduce(or_, (F.lower(F.translate(F.coalesce(comment, F.lit("")), "\u3000", " ")).contains(w) for w in words))
    marked = reduce(or_, (F.lower(F.trim(F.coalesce(type_, F.lit("")))).endswith(m) for m in COUNTS_UP))
    return marked | (said(COUNTS_UP_SAID) & ~said(DOES_NOT_COUNT_UP))


def plain_type(type_: Column) -> Column:
    """A type without a mark of an identity column."""
    return F.trim(F.regexp_replace(F.trim(type_), "(?i)(" + "|".join(map(re.escape, COUNTS_UP)) + ")$", ""))


def sheet_formats(grid: DataFrame) -> DataFrame:
    """path, sheet, score_a, score_b and format (A, B or unknown): titles, labels and header rows near the top of a sheet count."""
    rows = grid.withColumn("t", F.transform("cells", token))
    has = lambda word, most: F.array_contains(F.slice("t", 1, most), word)
    seen = lambda holds, most: F.max(F.when((F.col("row_idx") < most) & holds, 1).otherwise(0))
    header = has(WORDS["logical_name"][0], 999) & has(WORDS["physical_name"][0], 999) & has(WORDS["type"][0], 999)
    number = F.arrays_overlap("t", F.array(*map(F.lit, ("no", "no.", "no,"))))
    vertical = number & has(LOGICAL_TABLE, 999) & has(PHYSICAL_TABLE, 999)
    top = lambda word: F.max(F.when((F.col("row_idx") == 0) & (F.get("t", F.lit(0)) == word), 1).otherwise(0))
    found = rows.groupBy("path", "sheet").agg(
        (5 * top(TITLE_A) + 2 * seen(has(TITLE_A, 3), 3) + 2 * seen(header, 40)).alias("a"),
        (6 * top(TITLE_B) + 2 * seen(has(TITLE_B, 3), 3) + 3 * seen(vertical, 80)).alias("b"),
        (seen(has(LOGICAL_TABLE, 20), 25) * seen(has(PHYSICAL_TABLE, 20), 25)).alias("labels"),
    )
    a, b = F.col("a") + F.col("labels"), F.col("b") + F.col("labels")
    return found.select("path", "sheet", a.alias("score_a"), b.alias("score_b"), F.when(a > b, "A").when(b > a, "B").otherwise("unknown").alias("format"))


def search_index(grid: DataFrame, definitions: DataFrame) -> DataFrame:
    """What can be searched for in workbooks: sheets, and the tables they define; has_tables says if a sheet has any."""
    tables = definitions.select("path", "sheet", "table_name").distinct()
    with_tables = tables.select("path", "sheet").distinct().withColumn("has_tables", F.lit(True))
    sheets = grid.select("path", "sheet").distinct().join(with_tables, ["path", "sheet"], "left")
    sheets = sheets.select("path", "sheet", F.lit("sheet").alias("kind"), F.col("sheet").alias("name"), F.coalesce("has_tables", F.lit(False)).alias("has_tables"))
    return sheets.unionByName(tables.select("path", "sheet", F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.lit(True).alias("has_tables")))


def region(grid: DataFrame, sheet: str, first_row: int, last_row: int, first_col: int, last_col: int) -> DataFrame:
    """The rows of a region of a sheet, cut to its columns, below the nearest table name: in the region, or else in the rows above,
    where labels may stand a little to the side. What ``table_definitions`` takes."""
    rows = grid.where((F.col("sheet") == sheet) & F.col("row_idx").between(first_row - ABOVE, last_row))
    left, width = max(0, first_col - LEFT), last_col + RIGHT - max(0, first_col - LEFT) + 1
    inside = F.col("row_idx") >= first_row
    named = F.exists(F.transform("cells", token), lambda t: t.isin(TABLE_NAME))
    by = W.partitionBy("path", "sheet")
    near = F.max(F.when(named, F.when(inside, F.lit(1 << 30)).otherwise(F.col("row_idx")))).over(by)
    rows = rows.withColumn("near", near).where(inside | (F.col("row_idx") == F.col("near")))
    cells = F.when(inside, F.slice("cells", first_col + 1, last_col - first_col + 1)).otherwise(F.slice("cells", left + 1, width))
    return rows.withColumn("cells", cells).select(*grid.columns)


#: Headers of sheets that define enumerations.
ENUM_HEADERS = {
    "class": ["グループ", "クラス", "group", "class", "enum", "枚举", "グループ名", "クラス名"],
    "name": ["定数", "constant", "name", "key", "コード", "code", "常量", "定数名"],
    "value": ["値", "value", "val", "コード値"],
    "label": ["ラベル", "label", "説明", "description", "名称", "desc"],
}
ENUM_ROWS = 50


def enum_constants(grid: DataFrame) -> DataFrame:
    """path, sheet, row, class_name, name, value, label and duplicate of the constants that sheets define, below the first row (of the first
    ENUM_ROWS) that has headers for class, name and value in different columns. Rows without a class aren't constants; a constant
    that its class has already is a duplicate, and so is one without a name."""
    low = F.transform("cells", lambda x: F.lower(F.trim(x)))
    place = lambda f: F.array_position(F.transform(low, lambda c: c.isin(ENUM_HEADERS[f])), F.lit(True)).cast("int")
    rows = grid.withColumns({f: place(f) for f in ENUM_HEADERS})
    apart = (F.col("class") > 0) & (F.col("name") > 0) & (F.col("value") > 0) & (F.col("class") != F.col("name")) & (F.col("name") != F.col("value")) & (F.col("class") != F.col("value"))
    found = rows.where(apart & (F.col("row_idx") < ENUM_ROWS)).groupBy("path", "sheet").agg(F.min(F.struct("row_idx", "class", "name", "value", "label")).alias("h"))
    cell = lambda f: F.trim(F.coalesce(F.get("cells", F.col(f"h.{f}") - 1), F.lit("")))
    label = F.when((F.col("h.label") > 0) & ~F.col("h.label").isin(F.col("h.class"), F.col("h.name"), F.col("h.value")), F.nullif(cell("label"), F.lit("")))
    rows = grid.join(F.broadcast(found), ["path", "sheet"]).where(F.col("row_idx") > F.col("h.row_idx"))
    rows = rows.select("path", "sheet", F.col("row_idx").alias("row"), cell("class").alias("c"), cell("name").alias("n"), cell("value").alias("value"), label.alias("label")).where("c != ''")
    rows = rows.withColumn("class_name", text.class_name(F.col("c"))).withColumn("name", text.constant_name(F.col("n")))
    again = F.row_number().over(W.partitionBy("path", "sheet", "class_name", "name", F.col("n") == "").orderBy("row")) > 1
    return rows.select("path", "sheet", "row", "class_name", "name", "value", "label", (again | (F.col("n") == "")).alias("duplicate"))


def table_definitions(grid: DataFrame, empty_rows: int = 10) -> DataFrame:
    """path, sheet, table_name, position and the fields of each column that the sheets define.

    A definition is a row with a table name beside its label, a header row below it, and rows up to the next definition or
    to ``empty_rows`` rows in a row without a name. Rows that describe the table, and headers that are repeated, are left out; of
    tables with the same name in a sheet the first counts. All of that is windows over a sheet's rows.
    """
    rows = grid.withColumn("low", F.transform("cells", token))
    label = F.array_position(F.transform("low", lambda x: x.isin(TABLE_NAME)), F.lit(True))
    beside = F.filter(F.slice("cells", label.cast("int") + 1, 999), lambda x: ~token(x).isin("", LOGICAL_TABLE, PHYSICAL_TABLE, "説明", "rdbms", "engine", "charset"))
    has = lambda field: F.arrays_overlap("low", F.array(*map(F.lit, WORDS[field])))
    header = has("physical_name") & has("type")
    by = W.partitionBy("path", "sheet").orderBy("row_idx")
    rows = rows.withColumn("table_name", F.when(label > 0, F.coalesce(F.get(beside, 0), F.lit("")))).withColumn("is_header", header)
    rows = rows.withColumn("block", F.sum(F.col("table_name").isNotNull().cast("int")).over(by)).where("block > 0")
    inside = W.partitionBy("path", "sheet", "block").orderBy("row_idx")
    place = lambda names: F.array_position(F.transform("low", lambda c: c.isin(names)), F.lit(True)).cast("int")
    places = F.when(F.col("is_header"), F.create_map(*(x for f, names in WORDS.items() for x in (F.lit(f), place(names)))))
    rows = rows.withColumns({"table_name": F.first("table_name", ignorenulls=True).over(inside), "at": F.first(places, ignorenulls=True).over(inside)})
    rows = rows.where("at is not null and not is_header")
    cell = lambda f: F.when(F.col("at")[f] > 0, F.nullif(F.get("cells", F.col("at")[f] - 1), F.lit("")))
    rows = rows.select("path", "sheet", "block", "row_idx", "table_name", *(cell(f).alias(f) for f in WORDS))
    named = F.col("physical_name").isNotNull()
    last = F.last(F.when(named, F.col("row_idx")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    gap = F.coalesce(F.col("row_idx") - last > empty_rows, F.lit(False))
    rows = rows.where(named).withColumn("cut", F.max(gap.cast("int")).over(inside)).where("cut = 0")
    words = [w for names in WORDS.values() for w in names]
    about = token(F.coalesce("logical_name", F.lit(""))).isin(ABOUT_TABLE) | token(F.col("physical_name")).isin(ABOUT_ENGINE) | token(F.coalesce("no", F.lit(""))).isin(words)
    rows = rows.where(~about)
    again = F.min("block").over(W.partitionBy("path", "sheet", "table_name"))
    rows = rows.withColumn("first_block", again).where("block = first_block")
    x = cells.type_and_size(plain_type(F.col("type")), F.col("size"))
    return rows.select(
        "path",
        "sheet",
        "table_name",
        F.row_number().over(inside).alias("position"),
        "logical_name",
        "physical_name",
        x["type"].alias("type"),
        x["size"].alias("size"),
        not_null_flag(F.col("not_null")).alias("not_null"),
        F.coalesce(token(F.col("pk")).isin([*PK_MARKS, "y"]), F.lit(False)).alias("is_pk"),
        counts_up(F.col("type"), F.col("comment")).alias("auto_increment"),
        "comment",
    )


def definition_sheets(columns: list[dict]) -> dict[str, list[list[str]]]:
    """Sheets that table_definitions reads back, one a table. A catalog is small: its rows are on the driver."""
    out: dict[str, list[list[str]]] = {}
    for c in columns:
        sheet = out.setdefault(c["table_name"][:31], [["Table name", c["table_name"]], [], ["Logical name", "Physical name", "Data type", "Length", "Required", "Primary key", "Comment"]])
        sheet.append([c.get("logical_name") or "", c["physical_name"], c["type"], c.get("size") or "", "Y" if c.get("not_null") else "", "Y" if c.get("is_pk") else "", c.get("comment") or ""])
    return out


def patched(grid: DataFrame, patches: DataFrame) -> DataFrame:
    """The grid with single cells replaced. ``patches``: sheet, row_idx, col_idx, value."""
    by_row = patches.groupBy("sheet", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("p"))
    cells = F.when(F.col("p").isNull(), F.col("cells")).otherwise(F.transform("cells", lambda x, i: F.coalesce(F.col("p")[i], x)))
    return grid.join(by_row, ["sheet", "row_idx"], "left").withColumn("cells", cells).select(*grid.columns)


#: Columns to the left of a table's label that belong to it, where tables stand side by side.
SIDE_LEFT = 2


def strips(grid: DataFrame) -> DataFrame:
    """The parts of sheets where tables stand side by side, as sheets of their own: ``grid`` with strip (from 1, within the sheet), and the
    cells of that strip. A row with several table labels begins a band, which ends at the next such row; each label's strip goes
    from a little left of it to a little left of the next label, or to the end of the row."""
    t = F.transform("cells", token)
    places = F.filter(F.transform(t, lambda x, i: F.when(x.isin(TABLE_NAME), i)), lambda i: i.isNotNull())
    rows = grid.withColumn("_at", places)
    begins = F.size("_at") > 1
    band = F.sum(begins.cast("int")).over(W.partitionBy("path", "sheet").orderBy("row_idx"))
    rows = rows.withColumn("_band", band).where("_band > 0")
    heads = rows.where(begins).select("path", "sheet", "_band", F.posexplode(F.transform("_at", lambda x, i: F.struct(F.greatest(x - SIDE_LEFT, F.lit(0)).alias("a"), (F.coalesce(F.get("_at", i + 1), F.lit(1 << 20)) - SIDE_LEFT).alias("b")))).alias("_i", "_x"))
    heads = heads.withColumn("strip", F.row_number().over(W.partitionBy("path", "sheet").orderBy("_band", "_i")))
    cut = F.slice("cells", F.col("_x.a") + 1, F.col("_x.b") - F.col("_x.a"))
    return rows.join(heads, ["path", "sheet", "_band"]).withColumn("cells", cut).select(*grid.columns, "strip")


def all_definitions(grid: DataFrame, empty_rows: int = 10) -> DataFrame:
    """``table_definitions`` of tables side by side, and then of those below each other; of equal names in a sheet the first counts."""
    mark = "\u0001"
    side = strips(grid).withColumn("sheet", F.concat_ws(mark, "sheet", "strip")).drop("strip")
    beside = table_definitions(side, empty_rows).withColumn("_strip", F.element_at(F.split("sheet", mark), -1).cast("int")).withColumn("sheet", F.element_at(F.split("sheet", mark), 1))
    first = F.min("_strip").over(W.partitionBy("path", "sheet", "table_name"))
    beside = beside.withColumn("_first", first).where("_strip = _first").drop("_strip", "_first")
    names = beside.select("path", "sheet", "table_name").distinct()
    return beside.unionByName(table_definitions(grid, empty_rows).join(names, ["path", "sheet", "table_name"], "left_anti"))
