"""Data-changing statements as transforms of table images.

Each returns ``Change(table, affected)``: the new image of the table, and the rows a RETURNING clause yields. Conflicts are
judged on one declared key, and joins on it are shuffled once. A batch that holds a key twice fails when it is read, but for
insert-or-ignore, where the first row by ``order`` (then by all columns) counts, and insert-or-replace, where the last does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConflictError(ValueError):
    pass


@dataclass(frozen=True)
class Change:
    table: DataFrame
    affected: DataFrame

    def returning(self, *columns) -> DataFrame:
        return self.affected.select(*columns) if columns else self.affected


def _aligned(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with all columns of the table; columns that are absent are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows, which raise when they are read if a key occurs twice; shuffled by the key, as the join after it needs them."""
    n = F.count("*").over(Window.partitionBy(*key))
    said = F.raise_error(F.concat(F.lit("key occurs more than once: "), F.to_json(F.struct(*key)))).cast("boolean")
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, said).otherwise(True)).drop("_n")


def insert(table: DataFrame, rows: DataFrame) -> Change:
    """INSERT VALUES and INSERT SELECT."""
    rows = _aligned(table, rows)
    return Change(table.unionByName(rows), rows)


def insert_or(table: DataFrame, rows: DataFrame, action: str, key: list[str], order: Column | None = None) -> Change:
    """action: ignore, replace, abort, fail or rollback. The last three check the keys and raise before anything changes."""
    rows = _aligned(table, rows)
    if action == "ignore":
        first = Window.partitionBy(*key).orderBy(*([order] if order is not None else []), *table.columns)
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        new = rows.join(table.select(*key), key, "left_anti").select(*table.columns)
        return Change(table.unionByName(new), new)
    if action == "replace":
        last = Window.partitionBy(*key).orderBy(*([order.desc()] if order is not None else []), *[F.desc(c) for c in table.columns])
        rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        kept = table.join(rows.select(*key), key, "left_anti").select(*table.columns)
        return Change(kept.unionByName(rows), rows)
    if action not in ("abort", "fail", "rollback"):
        raise ValueError(f"unknown action {action}")
    clash = rows.groupBy(*key).count().where("count > 1").select(*key).unionByName(rows.select(*key).join(table.select(*key), key, "left_semi"))
    if not clash.isEmpty():
        raise ConflictError(f"a key of {key} exists already")
    return insert(table, rows)


def replace(table: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> Change:
    return insert_or(table, rows, "replace", key, order)


def upsert_nothing(table: DataFrame, rows: DataFrame, key: list[str]) -> Change:
    """ON CONFLICT DO NOTHING."""
    return insert_or(table, rows, "ignore", key)


def upsert_update(table: DataFrame, rows: DataFrame, key: list[str], assign: dict[str, Column], where: Column | None = None) -> Change:
    """ON CONFLICT (key) DO UPDATE SET … [WHERE …]; expressions see the old row as ``t`` and the proposed one as ``excluded``."""
    rows = unique(_aligned(table, rows), key)
    t, x = table.withColumn("_old", F.lit(True)).alias("t"), rows.withColumn("_new", F.lit(True)).alias("excluded")
    joined = t.join(x, _same(key, "t", "excluded"), "full")
    both = F.col("t._old").isNotNull() & F.col("excluded._new").isNotNull()
    hit = both & F.coalesce(where, F.lit(False)) if where is not None else both
    cols = []
    for c in table.columns:
        kept = F.when(F.col("t._old").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}"))
        cols.append((F.when(hit, assign[c]).otherwise(kept) if c in assign else kept).cast(table.schema[c].dataType).alias(c))
    done = joined.select(*cols, (hit | F.col("t._old").isNull()).alias("_changed"))
    return Change(done.drop("_changed"), done.where("_changed").drop("_changed"))


def update(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> Change:
    """UPDATE SET … [WHERE …]. Columns not in ``assign`` stay; ``F.lit(None)`` sets null."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    cols = [(F.when(hit, assign[c]).otherwise(F.col(c)) if c in assign else F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    after = [(assign[c] if c in assign else F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    return Change(table.select(*cols), table.where(hit).select(*after))


def update_from(table: DataFrame, source: DataFrame, key: list[str], assign: dict[str, Column], where: Column | None = None) -> Change:
    """UPDATE … FROM source, matched on key columns (unique in the source); the old row is ``t``, the source ``s``."""
    t, s = table.alias("t"), unique(source, key).withColumn("_hit", F.lit(True)).alias("s")
    joined = t.join(s, _same(key, "t", "s"), "left")
    hit = F.col("s._hit").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    cols = [(F.when(hit, assign[c]).otherwise(F.col(f"t.{c}")) if c in assign else F.col(f"t.{c}")).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    done = joined.select(*cols, hit.alias("_changed"))
    return Change(done.drop("_changed"), done.where("_changed").drop("_changed"))


def delete(table: DataFrame, where: Column | None = None) -> Change:
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return Change(table.where(~hit), table.where(hit))
