"""Kinds of sources with their fields, checks of what was filled in, and classes of connection errors."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import SparkSession


class Source(Protocol):
    def test(self, spark: SparkSession) -> tuple[bool, str | None]: ...

    def introspect(self, spark: SparkSession) -> list[tuple[str, str, str, bool]]: ...


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"  # text, number, secret, choice
    required: bool = True
    default: Any = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Connector:
    kind: str
    label: str
    fields: tuple[Field, ...]
    queryable: bool


def _db(port: int) -> tuple[Field, ...]:
    return (Field("host"), Field("port", "number", False, port), Field("database"), Field("user"), Field("password", "secret", False))


#: Sources that can be described; those marked queryable can be read here, through files or JDBC.
CONNECTORS = {
    c.kind: c
    for c in (
        Connector("parquet", "Parquet folder", (Field("path"),), True),
        Connector("postgresql", "PostgreSQL", (*_db(5432), Field("schema", "text", False, "public"), Field("ssl", "choice", False, "prefer", ("disable", "prefer", "require"))), True),
        Connector("mysql", "MySQL", _db(3306), False),
        Connector("sqlserver", "SQL Server", _db(1433), False),
        Connector("trino", "Trino", (Field("host"), Field("port", "number", False, 8080), Field("catalog"), Field("schema", "text", False), Field("user")), False),
        Connector("snowflake", "Snowflake", (Field("account"), Field("warehouse"), Field("database"), Field("user"), Field("password", "secret")), False),
        Connector("bigquery", "BigQuery", (Field("project"), Field("dataset"), Field("credentials", "secret", False)), False),
    )
}


def validate_options(kind: str, given: dict[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """The options with defaults filled in, and what is wrong with them."""
    c = CONNECTORS.get(kind)
    if c is None:
        return {}, [f"unknown kind {kind}"]
    out, wrong = {}, [f"unknown field {n}" for n in sorted(set(given) - {f.name for f in c.fields})]
    for f in c.fields:
        v = given.get(f.name, f.default)
        v = v.strip() if isinstance(v, str) else v
        if v in (None, ""):
            if f.required:
                wrong.append(f"{f.name} is missing")
            continue
        if f.kind == "number" and not (str(v).isdigit() and 0 < int(v) < 65536):
            wrong.append(f"{f.name} is no port")
        elif f.kind == "choice" and v not in f.choices:
            wrong.append(f"{f.name} is none of {', '.join(f.choices)}")
        else:
            out[f.name] = int(v) if f.kind == "number" else v
    return out, wrong


@dataclass(frozen=True)
class ConnectionProblem:
    kind: str
    field: str | None


# SQLSTATE classes and states of JDBC errors, exceptions of the JVM, Spark's conditions, and words that
# drivers use where they give neither; with the kind of problem and the field to look at.
STATES = {"28": ("bad_credentials", "password"), "3D": ("unknown_database", "database"), "08": ("refused", "port"), "HYT": ("timeout", "host"), "42501": ("forbidden", None), "3F": ("not_found", "schema")}
EXCEPTIONS = {
    "UnknownHostException": ("unknown_host", "host"), "NoRouteToHostException": ("refused", "host"), "ConnectException": ("refused", "port"), "SocketTimeoutException": ("timeout", "host"),
    "SSLException": ("tls", "ssl"), "SSLHandshakeException": ("tls", "ssl"), "CertificateException": ("tls", "ssl"), "ClassNotFoundException": ("driver_missing", None), "AccessControlException": ("forbidden", None),
    "FileNotFoundException": ("not_found", "path"),
}
CONDITIONS = {"PATH_NOT_FOUND": ("not_found", "path"), "FAILED_READ_FILE": ("unreadable", "path"), "CANNOT_READ_FILE_FOOTER": ("unreadable", "path"), "DATA_SOURCE_NOT_FOUND": ("driver_missing", None)}
WORDS = (
    ({"suitable", "driver"}, ("driver_missing", None)), ({"parquet", "not"}, ("unreadable", "path")), ({"certificate"}, ("tls", "ssl")), ({"ssl"}, ("tls", "ssl")),
    ({"database", "exist"}, ("unknown_database", "database")), ({"unknown", "database"}, ("unknown_database", "database")), ({"unknown", "host"}, ("unknown_host", "host")),
    ({"authentication"}, ("bad_credentials", "password")), ({"password"}, ("bad_credentials", "password")), ({"login"}, ("bad_credentials", "password")),
    ({"refused"}, ("refused", "port")), ({"timed", "out"}, ("timeout", "host")), ({"timeout"}, ("timeout", "host")), ({"permission", "denied"}, ("forbidden", None)), ({"exist"}, ("not_found", "path")),
)


def _is_a(java: Any, name: str) -> bool:
    c = java.getClass()
    while c is not None and c.getName() != name:
        c = c.getSuperclass()
    return c is not None


def _told(error: BaseException | str) -> tuple[str, list[str], list[str]]:
    """The text of an error and its causes, the names of their classes, and their SQLSTATEs."""
    texts, names, states = [str(error)], [type(error).__name__], []
    java = getattr(error, "java_exception", None)
    while java is not None:
        texts.append(str(java.toString()))
        names.append(java.getClass().getSimpleName())
        if _is_a(java, "java.sql.SQLException") and java.getSQLState():
            states.append(str(java.getSQLState()))
        java = java.getCause()
    text = " ".join(texts)
    return text, names + re.findall(r"\b\w+Exception\b", text), states + re.findall(r"SQLSTATE\W{1,3}(\w{5})", text)


def classify_error(error: BaseException | str) -> ConnectionProblem:
    """Kind of a connection error, and the field that is likely wrong: by Spark's condition, SQLSTATE, exception, or words."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    text, names, states = _told(error)
    said = set(re.findall(r"[a-z]+", text.lower()))
    found = [v for k, v in CONDITIONS.items() if condition.startswith(k)]
    found += [v for s in states for k, v in STATES.items() if s.startswith(k)]
    found += [EXCEPTIONS[n] for n in names if n in EXCEPTIONS]
    found += [v for some, v in WORDS if some <= said]
    return ConnectionProblem(*(found or [("other", None)])[0])


def jdbc_reader(options: dict[str, Any]) -> Callable[[SparkSession, str], Any]:
    """A reader of PostgreSQL tables through JDBC, partitioned by a numeric key if one is named."""

    def read(spark: SparkSession, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> Any:
        url = f"jdbc:postgresql://{options['host']}:{options.get('port', 5432)}/{options['database']}"
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{options.get('schema', 'public')}.{table}")
        reader = reader.option("user", options["user"]).option("password", options.get("password", "")).option("fetchsize", 10_000)
        if key:
            reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        return reader.load()

    return read
