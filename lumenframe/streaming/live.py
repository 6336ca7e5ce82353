"""Live queries with Structured Streaming: a query over a table that grows, delivered anew after what was added to it.

Deliveries are DataFrames, so a snapshot of any size stays in Spark; a consumer that asks late gets the newest one only, as
a run takes all that is new at once. Failed runs go on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def file_snapshots(spark: SparkSession, folder: str, schema, query: Callable[[DataFrame], DataFrame], checkpoint: str, deliver: Callable[[int, DataFrame], None]) -> None:
    """Runs an aggregate query over all files so far, once for what is new; repeated calls go on from the checkpoint."""
    stream = query(spark.readStream.schema(schema).parquet(folder))
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: deliver(n, df)).start()
    run.awaitTermination()


def first_row(*order) -> Callable[[DataFrame], DataFrame]:
    """For a live query of one row: what :func:`file_snapshots` delivers, cut to its first row in the given order."""
    return lambda df: df.orderBy(*order).limit(1)
