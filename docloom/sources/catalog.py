"""Tables by name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import TableDoesNotExistError
from docloom.session import in_utc

#: A table, or what makes it when it is first used.
Table = DataFrame | Callable[[], DataFrame]
FORMATS = ("parquet", "json", "orc", "csv", "avro")


class Catalog:
    """DataFrames given by name, files of a folder, and the session's own tables, in this order.

    A file or folder `name.format` is read as that format. Timestamps without zone are UTC.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, Table] | None = None, folder: str | None = None, schemas: dict[str, T.StructType] | None = None):
        in_utc(spark)
        self.spark, self.tables, self.folder, self.schemas = spark, dict(tables or {}), folder, dict(schemas or {})

    def register(self, name: str, df: Table) -> None:
        self.tables[name] = df

    def _given(self, name: str) -> DataFrame:
        df = self.tables[name]
        if not isinstance(df, DataFrame):
            df = self.tables[name] = df()
        return df

    def __contains__(self, name: str) -> bool:
        return name in self.tables or self._file(name) is not None or (name.replace("_", "").isalnum() and self.spark.catalog.tableExists(name))

    def _file(self, name: str) -> tuple[str, str] | None:
        if not self.folder or "/" in name:
            return None
        for f in FORMATS:
            p = os.path.join(self.folder, f"{name}.{f}")
            if os.path.exists(p):
                return p, f
        return None

    def read(self, path: str, fmt: str, name: str = "") -> DataFrame:
        r = self.spark.read
        if name in self.schemas:
            r = r.schema(self.schemas[name])
        if fmt == "csv":
            r = r.option("header", "true")
        if fmt == "json":
            r = r.option("multiLine", "false")
        return r.format(fmt).load(path)

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            df = self._given(name)
        elif found := self._file(name):
            df = self.read(*found, name)
        elif "." in name and name.split(".", 1)[1] in self.tables:
            df = self._given(name.split(".", 1)[1])
        elif name.replace("_", "").isalnum() and self.spark.catalog.tableExists(name):
            df = self.spark.table(name)
        else:
            raise TableDoesNotExistError(name)
        return zoned(df)


def zoned(df: DataFrame) -> DataFrame:
    """Top-level timestamps without zone as UTC ones."""
    ntz = {f.name: F.col("`" + f.name + "`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(ntz) if ntz else df
