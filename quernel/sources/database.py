"""Databases read through JDBC: test, introspection, keys, duplicates, match rates, statistics.

Everything is SQL that the database runs, or Spark's JDBC scans with pushed
filters and columns; catalogs come from ``information_schema``, which all kinds
here but BigQuery's projects have in one form. The reader of queries is passed
in, so that a test can put tables in the place of a database.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import Catalog, Column, Relationship, Table
from quernel.operators import profile
from quernel.sources.connectors import CONNECTORS, classify_error

# JDBC addresses by kind, and the folder (schema) of tables where none is given.
ADDRESSES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "public"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", None),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "dbo"),
    "trino": ("jdbc:trino://{host}:{port}/{catalog}", None),
    "snowflake": ("jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}&warehouse={warehouse}", "PUBLIC"),
    "bigquery": ("jdbc:bigquery://https://www.googleapis.com/bigquery/v2;ProjectId={project};DefaultDataset={dataset}", None),
}
TIMEOUT_S = 5
# The driver's class by kind, and the package that a session names in ``spark.jars.packages`` to have it.
DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "org.postgresql:postgresql"), "mysql": ("com.mysql.cj.jdbc.Driver", "com.mysql:mysql-connector-j"), "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "com.microsoft.sqlserver:mssql-jdbc"),
    "trino": ("io.trino.jdbc.TrinoDriver", "io.trino:trino-jdbc"), "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "net.snowflake:snowflake-jdbc"), "bigquery": ("com.simba.googlebigquery.jdbc.Driver", ""),
}

COLUMNS = "SELECT table_name, column_name, data_type, is_nullable, ordinal_position FROM {where}information_schema.columns WHERE table_schema = '{schema}'"
KEYS = """SELECT tc.table_name, kcu.column_name, tc.constraint_name, tc.constraint_type FROM information_schema.table_constraints tc
JOIN information_schema.key_column_usage kcu ON kcu.constraint_name = tc.constraint_name AND kcu.table_schema = tc.table_schema AND kcu.table_name = tc.table_name
WHERE tc.table_schema = '{schema}' AND tc.constraint_type IN ('PRIMARY KEY', 'UNIQUE')"""
LINKS = """SELECT kcu.table_name, kcu.column_name, ref.table_name AS target, ref.column_name AS target_column FROM information_schema.referential_constraints rc
JOIN information_schema.key_column_usage kcu ON kcu.constraint_name = rc.constraint_name AND kcu.constraint_schema = rc.constraint_schema
JOIN information_schema.key_column_usage ref ON ref.constraint_name = rc.unique_constraint_name AND ref.constraint_schema = rc.unique_constraint_schema AND ref.ordinal_position = kcu.position_in_unique_constraint
WHERE kcu.table_schema = '{schema}'"""

Reader = Callable[[str], DataFrame]


def missing_driver(spark: SparkSession, kind: str) -> str | None:
    """The package to add to the session for a kind of database; None if its driver is there. A session loads drivers when it starts, never later."""
    name, package = DRIVERS[kind]
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(name, False, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        return None
    except Exception:  # noqa: BLE001  the class isn't on the path
        return package or name


def jdbc_queries(spark: SparkSession, kind: str, options: dict[str, Any]) -> Reader:
    """A reader of queries that the database runs, in a short read-only session."""
    url = ADDRESSES[kind][0].format(**{f.name: f.default for f in CONNECTORS[kind].fields} | options)

    def read(sql: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("query", sql).option("queryTimeout", TIMEOUT_S).option("fetchsize", 10_000)
        for k in ("user", "password"):
            reader = reader.option(k, options[k]) if options.get(k) else reader
        if kind == "postgresql":
            reader = reader.option("sessionInitStatement", "SET default_transaction_read_only = on").option("sslmode", options.get("ssl", "prefer"))
        return reader.load()

    return read


@dataclass
class DatabaseSource:
    """One database's tables."""

    kind: str
    options: dict[str, Any]
    read: Reader
    _keys: list[tuple[str, str, str, str]] | None = field(default=None, repr=False)

    @property
    def schema(self) -> str:
        return self.options.get("schema") or ADDRESSES[self.kind][1] or self.options.get("database") or self.options.get("dataset") or ""

    @property
    def queryable(self) -> bool:
        return CONNECTORS[self.kind].queryable

    def _ask(self, sql: str) -> list[tuple]:
        where = f"{self.options['dataset']}." if self.kind == "bigquery" else ""
        return [tuple(r) for r in self.read(sql.format(schema=self.schema.replace("'", "''"), where=where)).collect()]

    def test(self, spark: SparkSession | None = None) -> tuple[bool, str | None]:
        """Whether the database answers and has tables to be read; else the kind of problem."""
        try:
            found = self._ask(COLUMNS)
        except Exception as e:  # noqa: BLE001  whatever the driver raises is classified
            return False, classify_error(e).kind
        return (True, None) if found else (False, "no_tables")

    def introspect(self, spark: SparkSession | None = None) -> list[tuple[str, str, str, bool]]:
        """(table, column, type, nullable), in the order of the tables' columns."""
        rows = sorted(self._ask(COLUMNS), key=lambda r: (r[0], r[4]))
        return [(t, c, k, str(n).upper() in ("YES", "TRUE", "1")) for t, c, k, n, _ in rows]

    def _constraints(self) -> list[tuple[str, str, str, str]]:
        if self._keys is None:
            self._keys = self._ask(KEYS) if self.kind not in ("trino", "bigquery") else []  # these declare no keys
        return self._keys

    def unique_keys(self) -> dict[str, set[str]]:
        """Columns that are a key by themselves, by table."""
        members: dict[tuple[str, str], list[str]] = {}
        for table, column, name, _ in self._constraints():
            members.setdefault((table, name), []).append(column)
        out: dict[str, set[str]] = {}
        for (table, _), columns in members.items():
            if len(columns) == 1:
                out.setdefault(table, set()).add(columns[0])
        return out

    def catalog(self) -> Catalog:
        """The tables with keys and links, nothing hidden."""
        primary = {(t, c) for t, c, _, k in self._constraints() if k == "PRIMARY KEY"}
        links = self._ask(LINKS) if self._constraints() else []
        by_table: dict[str, list[Column]] = {}
        for t, c, k, _ in self.introspect():
            by_table.setdefault(t, []).append(Column(c, k, primary_key=(t, c) in primary))
        return Catalog(tuple(Table(t, tuple(cs), relationships=tuple(sorted({Relationship(c, x, y) for a, c, x, y in links if a == t}, key=lambda r: r.column))) for t, cs in sorted(by_table.items())))

    def table(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table; a filter on the frame goes to the database."""
        some = ", ".join(columns) or "*"
        return self.read(f"SELECT {some} FROM {self.schema}.{name}" if self.schema else f"SELECT {some} FROM {name}")

    def row_estimates(self) -> dict[str, float]:
        """PostgreSQL's own estimates of rows; no table is read."""
        if self.kind != "postgresql":
            return {}
        return {t: max(0.0, float(n)) for t, n in self._ask("SELECT c.relname, c.reltuples FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = '{schema}' AND c.relkind IN ('r', 'p')")}

    def has_duplicates(self, table: str, column: str) -> bool:
        return profile.has_duplicates(self.table(table, column), column)

    def match_rate(self, table: str, column: str, target: str, target_column: str) -> float | None:
        return profile.match_rate(self.table(table, column), column, self.table(target, target_column), target_column).head()["rate"]

    def column_stats(self, table: str, columns: list[str]) -> DataFrame:
        """column, n, null_share, blank_share, n_values, complete, values of a table's columns."""
        df = self.table(table, *columns)
        some = profile.domains(df, columns)
        return profile.shares(df, columns).join(some, "column", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
