"""Tables: declared schemas, scans of Parquet folders, views, and created tables."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class TableDef:
    """A named table with typed columns; ``key`` is the declared unique key that conflict rules use."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()

    def scan(self, spark: SparkSession, folder: str, alias: str | None = None) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{self.name}.parquet").select(*self.schema.fieldNames())
        return df.alias(alias) if alias else df

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def create(self, spark: SparkSession, name: str | None = None, path: str | None = None) -> str:
        """CREATE TABLE IF NOT EXISTS, at ``path`` or in the warehouse; the name may be qualified by a catalog and a schema."""
        name = name or self.name
        if not spark.catalog.tableExists(name):
            create_as(self.empty(spark), name, path)
        return name


def scan(spark: SparkSession, folder: str, name: str, alias: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.alias(alias) if alias else df


def create_as(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS name AS query, at ``path`` or in the warehouse."""
    df.write.format("parquet").mode("ignore").options(**({"path": path} if path else {})).saveAsTable(name)
    return df.sparkSession.table(name)


def view(df: DataFrame, name: str) -> DataFrame:
    """A view is read exactly like a table."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def validate(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Analyses the query, without running it, against the declared row."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in expected.fields]
    if got != want:
        raise SchemaError(f"declared {want}, found {got}")
    for g, w in zip(df.schema.fields, expected.fields):
        if g.nullable and not w.nullable:
            raise SchemaError(f"{g.name} may be null but is declared required")
    return df


@dataclass
class Namespace:
    """Allocates aliases that no other name uses, whatever its case."""

    taken: set = field(default_factory=set)
    count: dict = field(default_factory=dict)

    def reserve(self, name: str) -> str:
        if name.lower() in self.taken:
            raise SchemaError(f"the alias {name} is taken")
        self.taken.add(name.lower())
        return name

    def next(self, prefix: str) -> str:
        counter = self.count.setdefault(prefix, itertools.count())
        while (name := f"{prefix}{next(counter)}").lower() in self.taken:
            pass
        return self.reserve(name)


def nested(df: DataFrame, alias: str, prefix: str) -> list:
    """The columns of a nested row, flattened to prefix_column."""
    return [F.col(f"{alias}.{c}").alias(f"{prefix}_{c}") for c in df.columns]


def rebuilt(df: DataFrame, prefix: str) -> DataFrame:
    """The flattened columns of a nested row gathered into a struct again."""
    mine = [c for c in df.columns if c.startswith(prefix + "_")]
    row = F.struct(*[F.col(c).alias(c[len(prefix) + 1 :]) for c in mine]).alias(prefix)
    return df.select(*[c for c in df.columns if c not in mine], row)
