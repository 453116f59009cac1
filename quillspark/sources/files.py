"""Scans, CSV files, JDBC options and connection strings."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import sqltext
from quillspark.shared import fresh_dir


def write_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes one small file to a new folder within the shared one, and gives that folder."""
    from pyarrow import fs

    folder = fresh_dir(spark, "file")
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file:///" + folder.removeprefix("file:").lstrip("/"))
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return folder


def scan(df: DataFrame, where: str | None = None) -> DataFrame:
    """A scan with an optional filter text of one expression, which Catalyst pushes down."""
    condition = sqltext.single_expression(where)
    return df.where(condition) if condition else df


def write_csv(df: DataFrame, path: str, newline: str = "\r\n", delimiter: str = ",") -> None:
    df.write.csv(path, header=True, sep=delimiter, lineSep=newline, emptyValue="", nullValue="", quote='"', escape='"')


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """CSV with quoted line ends and doubled quotes; without a header, columns are column_1 and so on."""
    rows = spark.read.csv(path, schema=schema, header=header, sep=delimiter, multiLine=True, quote='"', escape='"', nullValue="")
    return rows if header or schema else rows.toDF(*(f"column_{i + 1}" for i in range(len(rows.columns))))


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = fresh_dir(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path, schema=", ".join(f"{n} {t}" for n, t in df.dtypes))


#: Default ports and what JDBC calls the five TLS modes.
PORTS = {"mysql": 3306, "postgresql": 5432}
TLS = {
    "mysql": {"disable": "DISABLED", "prefer": "PREFERRED", "require": "REQUIRED", "verify-ca": "VERIFY_CA", "verify-full": "VERIFY_IDENTITY"},
    "postgresql": {"disable": "disable", "prefer": "prefer", "require": "require", "verify-ca": "verify-ca", "verify-full": "verify-full"},
}


def parse_connection(text: str) -> dict:
    """driver, host, port, database, user, password and tls of a connection URL."""
    url = urlsplit(text.strip())
    driver = {"postgres": "postgresql", "mariadb": "mysql"}.get(url.scheme, url.scheme)
    if driver not in PORTS or not url.hostname:
        raise ValueError("not a mysql or postgresql connection URL")
    more = dict(parse_qsl(url.query))
    return {"driver": driver, "host": url.hostname, "port": url.port or PORTS[driver], "database": url.path.strip("/"), "user": unquote(url.username or ""), "password": unquote(url.password or ""), "tls": more.get("sslmode") or more.get("ssl-mode", "prefer").lower()}


def jdbc_options(connection: dict, table: str, partition: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Options of a JDBC read; ``partition`` is (column, lower, upper, number), without which one task reads all rows."""
    key = "sslMode" if connection["driver"] == "mysql" else "sslmode"
    out = {"url": f"jdbc:{connection['driver']}://{connection['host']}:{connection['port']}/{connection['database']}?{key}={TLS[connection['driver']][connection['tls']]}", "dbtable": table, "user": connection["user"], "password": connection["password"], "loginTimeout": "15"}
    if partition:
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    return out


def read_jdbc(spark: SparkSession, connection: dict, table: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(connection, table, partition)).load()
