from quillspark.sources import workbook

COLUMNS = [
    {"table_name": "orders", "logical_name": "Id", "physical_name": "id", "type": "bigint", "not_null": True, "is_pk": True, "comment": "key"},
    {"table_name": "orders", "logical_name": "注文名", "physical_name": "name", "type": "varchar", "size": "20", "not_null": False, "is_pk": False},
    {"table_name": "users", "physical_name": "code <&>", "type": "int", "not_null": True, "is_pk": False},
]


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook.write_workbook(workbook.definition_sheets(COLUMNS)))
    grid = workbook.read_grid(spark, f"file://{tmp_path}")
    found = sorted((r["table_name"], r["position"], r["physical_name"], r["type"], r["size"], r["not_null"], r["is_pk"]) for r in workbook.table_definitions(grid).collect())
    assert found == [("orders", 1, "id", "bigint", None, True, True), ("orders", 2, "name", "varchar", "20", False, False), ("users", 1, "code <&>", "int", None, True, False)]


def test_blocks_and_gaps(spark):
    rows = [["Table name", "a"], ["x"], ["Physical name", "Data type"], ["c1", "varchar（10）"], ["", ""], ["c2", "INT"], ["Physical table name", "b"], ["Physical name", "type"], ["d1", "date"], *([["", ""]] * 12), ["late", "int"]]
    grid = spark.createDataFrame([("p", 0, "s", i, r) for i, r in enumerate(rows)], workbook.GRID)
    found = sorted((r["table_name"], r["position"], r["physical_name"], r["type"], r["size"]) for r in workbook.table_definitions(grid).collect())
    assert found == [("a", 1, "c1", "varchar", "10"), ("a", 2, "c2", "int", None), ("b", 1, "d1", "date", None)]
    patch = spark.createDataFrame([("s", 3, 0, "C1")], "sheet string, row_idx int, col_idx int, value string")
    assert [r["cells"] for r in workbook.patched(grid, patch).where("row_idx = 3").collect()] == [["C1", "varchar（10）"]]


def test_labels():
    assert [workbook.column_label(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.column_number(workbook.column_label(n) + "7") == n for n in range(800))
