"""A clause-ordered query builder that ends in a DataFrame.

Each clause returns a new, immutable query; a clause out of order raises :class:`ClauseError` at once. ``order_by``
treats null as the smallest value, a negative limit is none, and compounds apply strictly from left to right.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fold_and_or
from ..sources.tables import Namespace


class ClauseError(ValueError):
    pass


class CardinalityError(ValueError):
    pass


# The order in which clauses may follow each other.
ORDER = ("from", "join", "where", "group", "having", "compound", "order", "limit", "offset")


def ascending(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_first()


def descending(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_last()


@dataclass(frozen=True)
class Query:
    columns: tuple = ()
    source: DataFrame | None = None
    ands: tuple = ()
    ors: tuple = ()
    groups: tuple | None = None
    having_: Column | None = None
    compounds: tuple = ()
    orders: tuple = ()
    limit_: int | None = None
    offset_: int | None = None
    at: int = -1
    names: Namespace = field(default_factory=Namespace, compare=False)

    def _step(self, clause: str, **changes) -> Query:
        place = ORDER.index(clause)
        if place < self.at:
            raise ClauseError(f"{clause} cannot follow {ORDER[self.at]}")
        return replace(self, at=place, **changes)

    def from_(self, df: DataFrame, alias: str | None = None) -> Query:
        if self.source is not None:
            raise ClauseError("from is given twice")
        return self._step("from", source=df.alias(self.names.reserve(alias) if alias else self.names.next("t")))

    def _join(self, df: DataFrame, alias: str | None, how: str, on: Column | None = None, using=None) -> Query:
        if self.source is None:
            raise ClauseError("join needs a from")
        df = df.alias(self.names.reserve(alias) if alias else self.names.next("t"))
        joined = self.source.join(df, list(using), how) if using else self.source.crossJoin(df) if on is None else self.source.join(df, on, how)
        return self._step("join", source=joined)

    def join(self, df: DataFrame, alias: str | None = None, on: Column | None = None, using=None) -> Query:
        return self._join(df, alias, "inner", on, using)

    def left_join(self, df: DataFrame, alias: str | None = None, on: Column | None = None, using=None) -> Query:
        return self._join(df, alias, "left", on, using)

    def right_join(self, df: DataFrame, alias: str | None = None, on: Column | None = None) -> Query:
        return self._join(df, alias, "right", on)

    def full_join(self, df: DataFrame, alias: str | None = None, on: Column | None = None) -> Query:
        return self._join(df, alias, "full", on)

    def cross_join(self, df: DataFrame, alias: str | None = None) -> Query:
        return self._join(df, alias, "cross")

    def natural_join(self, df: DataFrame, alias: str | None = None, how: str = "inner") -> Query:
        shared = [c for c in self.source.columns if c in df.columns]
        return self._join(df, alias, how, using=shared or None)

    def where(self, cond: Column) -> Query:
        return self._step("where", ands=(*self.ands, cond))

    and_ = where

    def or_(self, cond: Column) -> Query:
        return self._step("where", ors=(*self.ors, cond))

    def group_by(self, *keys) -> Query:
        return self._step("group", groups=keys)

    def having(self, cond: Column) -> Query:
        if self.groups is None:
            raise ClauseError("having needs a group by")
        return self._step("having", having_=cond)

    def _compound(self, kind: str, other) -> Query:
        return self._step("compound", compounds=(*self.compounds, (kind, other)))

    def union(self, other) -> Query:
        return self._compound("union", other)

    def union_all(self, other) -> Query:
        return self._compound("union all", other)

    def intersect(self, other) -> Query:
        return self._compound("intersect", other)

    def except_(self, other) -> Query:
        return self._compound("except", other)

    def order_by(self, *keys) -> Query:
        return self._step("order", orders=tuple(ascending(k) if isinstance(k, str) else k for k in keys))

    def limit(self, n: int) -> Query:
        return self._step("limit", limit_=n)

    def offset(self, n: int) -> Query:
        if self.limit_ is None:
            raise ClauseError("offset needs a limit")
        return self._step("offset", offset_=n)

    def df(self, spark: SparkSession | None = None) -> DataFrame:
        out = self.source if self.source is not None else (spark or SparkSession.active()).range(1)
        if self.ands or self.ors:
            out = out.where(fold_and_or(list(self.ands), list(self.ors)))
        if self.groups is not None:
            having = [self.having_.alias("_having")] if self.having_ is not None else []
            out = out.groupBy(*self.groups).agg(*[c for c in self.columns], *having) if self.columns else out.groupBy(*self.groups).agg(F.count("*").alias("n"), *having)
            if having:
                out = out.where("_having")
            named = [c for c in out.columns if c != "_having"]
            keys = len(self.groups)
            out = out.select(*named[keys:]) if self.columns and _repeats(named, keys) else out.select(*named)
        elif self.columns:
            if self.orders and not self.compounds:
                return self._cut(out.orderBy(*self.orders).select(*self.columns)) if _sortable(out, self) else self._cut(out.select(*self.columns).orderBy(*self.orders))
            out = out.select(*self.columns)
        for kind, other in self.compounds:
            other = other.df(spark) if isinstance(other, Query) else other
            out = {"union": lambda a, b: a.union(b).distinct(), "union all": lambda a, b: a.union(b), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[kind](out, other)
        if self.orders:
            out = out.orderBy(*self.orders)
        return self._cut(out)

    def _cut(self, out: DataFrame) -> DataFrame:
        if self.offset_:
            out = out.offset(self.offset_)
        return out if self.limit_ is None or self.limit_ < 0 else out.limit(self.limit_)


def _repeats(named: list[str], keys: int) -> bool:
    """Whether the select list names the grouping keys again."""
    return set(named[:keys]) <= set(named[keys:])


def _sortable(df: DataFrame, q: Query) -> bool:
    from pyspark.errors import AnalysisException

    try:
        df.orderBy(*q.orders).schema
    except AnalysisException:
        return False
    return True


def select(*columns) -> Query:
    return Query(columns=tuple(F.col(c) if isinstance(c, str) else c for c in columns))


def row(*columns: Column) -> list[Column]:
    """An anonymous row of one to six columns, c0 to c5."""
    if not 1 <= len(columns) <= 6:
        raise ClauseError("a row has one to six columns")
    return [c.alias(f"c{i}") for i, c in enumerate(columns)]


def exactly_one(df: DataFrame):
    rows = df.take(2)
    if len(rows) != 1:
        raise CardinalityError("no row" if not rows else "more than one row")
    return rows[0]


def zero_or_one(df: DataFrame):
    rows = df.take(2)
    if len(rows) > 1:
        raise CardinalityError("more than one row")
    return rows[0] if rows else None


def fetch_one(df: DataFrame):
    rows = df.take(1)
    return rows[0] if rows else None


def fetch_at_most(df: DataFrame, n: int) -> list:
    return df.take(n)


def cursor(df: DataFrame):
    """A lazy, single-pass iterator over the rows; one partition at a time reaches the driver."""
    return df.toLocalIterator(prefetchPartitions=False)
