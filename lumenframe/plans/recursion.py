"""Recursive common tables.

``union_all`` runs natively, up to ``limit`` rounds and, unless ``spark.sql.cteRecursionRowLimit`` is raised, as many rows as that setting allows; ``union`` removes repeated rows, so cyclic graphs terminate: it is evaluated semi-naively, each
round joining only the rows found new in the last one. Rounds are written to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


class RecursionError_(ValueError):
    pass


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that plans stay short and Spark knows its size."""
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_dir(spark)}/lumenframe/recursion-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def union_all(spark: SparkSession, name: str, columns: list[str], seed: str, step: str, final: str, limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE name(columns) AS (seed UNION ALL step) final."""
    return spark.sql(f"WITH RECURSIVE {name}({', '.join(columns)}) MAX RECURSION LEVEL {limit} AS ({seed} UNION ALL {step}) {final}")


def union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1_000_000) -> DataFrame:
    """The least fixed point of seed and step, each row once.

    A round looks up only what it found: a semi-join of the rows seen with the rows found, which Spark broadcasts
    while they are few, so the rows seen are scanned but not shuffled in each round.
    """
    seen = frontier = written(seed.distinct())
    for n in range(1, limit + 1):
        found = step(frontier)
        if found.columns != seen.columns:
            found = found.toDF(*seen.columns)
        found = written(found.distinct())
        same = F.lit(True)
        for c in seen.columns:
            same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
        known = seen.alias("old").join(found.alias("new"), same, "left_semi")
        frontier = written(found.subtract(known))
        if frontier.isEmpty():
            return seen
        # A union of written rounds; it is written itself now and then, so that plans stay short.
        seen = seen.unionByName(frontier)
        if n % 16 == 0:
            seen = written(seen)
    raise RecursionError_(f"no fixed point after {limit} rounds")
