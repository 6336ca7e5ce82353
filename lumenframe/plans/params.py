"""Declared queries: named parameters, nullability, completeness, cardinality and the declared row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import validate
from .query import exactly_one, zero_or_one


class BindingError(ValueError):
    pass


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    nullable: bool = False


def literal(value, kind: str):
    """A literal of the declared type, as SQL text takes it for a marker."""
    if value is None:
        return F.lit(None)
    if kind in ("bigint", "long"):
        return F.expr(f"{int(value)}L")
    return F.lit({"double": float, "string": str, "int": int, "boolean": bool}.get(kind, lambda v: v)(value))


@dataclass(frozen=True)
class QueryDef:
    """``body`` is SQL text with :name (or ?) markers, or a function of a session and the bound columns by name."""

    name: str
    body: str | Callable
    params: tuple[Param, ...] = ()
    result: T.StructType | None = None
    cardinality: str = "many"

    def bind(self, values: dict) -> dict:
        names = [p.name for p in self.params]
        if len(set(names)) != len(names):
            raise BindingError(f"{self.name} declares a parameter twice")
        if extra := set(values) - set(names):
            raise BindingError(f"{self.name} has no parameter {sorted(extra)}")
        if missing := [p for p in names if p not in values]:
            raise BindingError(f"{self.name} misses {missing}")
        for p in self.params:
            v = values[p.name]
            if v is None and not p.nullable:
                raise BindingError(f"{p.name} may not be null")
            if isinstance(v, float) and v != v:
                raise BindingError(f"{p.name} is not a number")
        return {p.name: values[p.name] for p in self.params}

    def df(self, spark: SparkSession, **values) -> DataFrame:
        bound = self.bind(values)
        if isinstance(self.body, str):
            out = spark.sql(self.body, args={p.name: literal(bound[p.name], p.type) for p in self.params})
        else:
            out = self.body(spark, **{p.name: F.lit(bound[p.name]).cast(p.type) for p in self.params})
        return validate(out, self.result) if self.result is not None else out

    def fetch(self, spark: SparkSession, **values):
        df = self.df(spark, **values)
        return {"many": DataFrame.collect, "exactlyOne": exactly_one, "zeroOrOne": zero_or_one, "command": lambda d: d.write.format("noop").mode("overwrite").save()}[self.cardinality](df)


def query(name: str, *params: Param, result: T.StructType | None = None, cardinality: str = "many"):
    """Decorator: the function builds a lazy DataFrame from a session and its bound parameters."""

    def made(fn: Callable) -> QueryDef:
        return QueryDef(name, wraps(fn)(fn), params, result, cardinality)

    return made


def indexed(spark: SparkSession, text: str, *values) -> DataFrame:
    """SQL with positional ? markers."""
    return spark.sql(text, args=[F.lit(v) for v in values])
