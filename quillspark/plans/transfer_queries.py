"""Queries of CSV files read in blocks, of dumps and of archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import dumps
from quillspark.plans.registry import query, table
from quillspark.shared import fresh_dir
from quillspark.sources import archives, csv_blocks


def csv_file(df: DataFrame, newline: str = "\r\n") -> str:
    """CSV without a header, as a client would send it, in a folder: a file for each task that writes, so that none writes all rows."""
    path = fresh_dir(df.sparkSession, "csv")
    df.select(F.concat_ws(",", *(text.csv_cell(F.col(c), ",", "\r") for c in df.columns)).alias("line")).write.option("lineSep", newline).text(path)
    return path


@query("select doc_id, lang, md5(text) as digest, length(text) as n_chars from (select doc_id, lang, nullif(text, '') as text from documents)")
def csv_documents(spark, folder):
    """Texts with line ends, quotes and commas, written as CSV and read block by block."""
    path = csv_file(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    rows = csv_blocks.read_csv_blocks(spark, path, "doc_id long, text string, lang string", header=False)
    return rows.select("doc_id", "lang", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


@query("select name, count(*) as n from (select case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then p_name || chr(10) || 'x \"y\"' else p_name || ',' end as name from part) where name <> '' group by name")
def csv_one_column(spark, folder):
    """Records of one empty cell are dropped."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "").when(k == 1, F.concat("p_name", F.lit('\nx "y"'))).otherwise(F.concat("p_name", F.lit(",")))
    rows = csv_blocks.read_csv_blocks(spark, csv_file(table(spark, folder, "part").select(name.alias("name")), "\n"), header=False)
    return rows.groupBy(F.col("column_1").alias("name")).agg(F.count("*").alias("n"))


DUMPED = {"nation": ["n_nationkey"], "region": ["r_regionkey"]}


@query("""select 'region/structure.sql' as member, 'DROP TABLE IF EXISTS `region`;' || chr(10) || 'CREATE TABLE `region` (' || chr(10) || '  `r_regionkey` INT NOT NULL,' || chr(10) || '  `r_name` TEXT,' || chr(10) || '  PRIMARY KEY (`r_regionkey`)' || chr(10) || ');' as text
union all select 'nation/structure.sql', 'DROP TABLE IF EXISTS `nation`;' || chr(10) || 'CREATE TABLE `nation` (' || chr(10) || '  `n_nationkey` INT NOT NULL,' || chr(10) || '  `n_name` TEXT,' || chr(10) || '  `n_regionkey` INT,' || chr(10) || '  PRIMARY KEY (`n_nationkey`)' || chr(10) || ');'
union all select 'region/data-000000.sql', 'INSERT INTO `region` (`r_regionkey`, `r_name`) VALUES' || chr(10) || '  ' || string_agg('(' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''')', ',' || chr(10) || '  ' order by r_regionkey) || ';' from region
union all select 'nation/data-000000.sql', string_agg(s, chr(10) order by b) from (select n_nationkey // 10 as b, 'INSERT INTO `nation` (`n_nationkey`, `n_name`, `n_regionkey`) VALUES' || chr(10) || '  ' || string_agg('(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')', ',' || chr(10) || '  ' order by n_nationkey) || ';' as s from nation group by 1)""")
def dump_archive(spark, folder):
    """DROP, CREATE and INSERT of two tables in one archive, read back."""
    members = [dumps.dump(table(spark, folder, name), name, keys, size=10, files=1) for name, keys in DUMPED.items()]
    path = fresh_dir(spark, "dump") + "/dump.zip"
    archives.write_archive(reduce(DataFrame.unionByName, members), path)
    lines = archives.read_archive(spark, path)
    each = F.array_sort(F.collect_list(F.struct("place", "text")))
    return lines.groupBy("member").agg(F.array_join(each["text"], "\n").alias("text"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def dumped_orders(spark, folder):
    """All orders, dumped to an archive of many members, and read from its INSERTs again."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = fresh_dir(spark, "dump") + "/orders.zip"
    archives.write_archive(dumps.dump(orders, "orders", ["o_orderkey"], "postgres", structure=False), path)
    cells = F.regexp_extract_all("text", F.lit(r"'(?:[^']|'')*'|[^(), ]+"), F.lit(0))
    rows = archives.read_archive(spark, path).where(F.startswith("text", F.lit("  ("))).select(cells.alias("x"))
    return rows.select(F.col("x")[0].cast("long").alias("o_orderkey"), F.col("x")[1].cast("long").alias("o_custkey"), F.regexp_extract(F.col("x")[2], "^'(.*)'$", 1).alias("o_orderstatus"), F.col("x")[3].cast("double").alias("o_totalprice"))
