"""Scalar user functions: registered once for a session, vectorised over Arrow batches by default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class FunctionError(ValueError):
    pass


_known: dict[tuple[int, str], tuple[Callable, str]] = {}


def scalar(name: str, returns: str, arity: int, vectorised: bool = True):
    """Decorator: a scalar function of fixed arity; call it with columns, or register it for SQL text."""

    def made(fn: Callable):
        def wrapped():  # needs a session, so not before the first use
            return F.pandas_udf(fn, returns) if vectorised else F.udf(fn, returns)

        def call(*columns):
            if len(columns) != arity:
                raise FunctionError(f"{name} takes {arity} arguments")
            return wrapped()(*columns)

        call.name, call.register = name, lambda spark: register(spark, name, wrapped(), fn, returns)
        return call

    return made


def register(spark: SparkSession, name: str, wrapped, fn: Callable, returns: str) -> str:
    key = (id(spark), name.lower())
    if key in _known and _known[key] != (fn, returns):
        raise FunctionError(f"{name} is registered with another body")
    if key not in _known:
        spark.udf.register(name, wrapped)
        _known[key] = (fn, returns)
    return name
