"""Parquet source: reading tables, registering views, describing schemas."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``, one Parquet file or folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def register_tables(spark: SparkSession, base: str, names: list[str]) -> list[str]:
    """Register each existing table as a temporary view; the names registered."""
    done = []
    for n in names:
        try:
            read_table(spark, base, n).createOrReplaceTempView(n)
            done.append(n)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return done


@dataclass(frozen=True)
class ParquetSource:
    """The `test` and `introspect` half of a source, over a folder of Parquet tables."""

    base: str

    def test(self, spark: SparkSession) -> tuple[bool, str | None]:
        """Whether the folder can be read, and if not the error's kind."""
        from quernel.sources.connectors import classify_error

        try:
            names = self.tables(spark)
            if names:
                read_table(spark, self.base, names[0]).schema
            return bool(names), None if names else "no_tables"
        except Exception as e:  # noqa: BLE001
            return False, classify_error(e).kind

    def tables(self, spark: SparkSession) -> list[str]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(os.path.splitext(n)[0] for n in names if n.endswith(".parquet"))

    def introspect(self, spark: SparkSession) -> list[tuple[str, str, str, bool]]:
        """(table, column, type, nullable) of every table, from the footers."""
        return [
            (t, f.name, f.dataType.simpleString(), f.nullable)
            for t in self.tables(spark)
            for f in read_table(spark, self.base, t).schema.fields
        ]
