"""Transactions: statements in order over images of tables, published together by plain Parquet writes.

Statements only extend lazy plans, each on the image the one before it left. When the block ends well, every changed
table is written to a new folder, and the new images take the old ones' place after the last write. When it
fails, or a write does, the tables stay as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from .dml import Change


class TransactionError(RuntimeError):
    pass


class Transaction:
    def __init__(self, tables: dict[str, DataFrame]):
        self.images, self.changed, self.open = dict(tables), set(), True

    def read(self, name: str) -> DataFrame:
        if not self.open:
            raise TransactionError("the transaction has ended")
        return self.images[name]

    def write(self, name: str, image: DataFrame) -> None:
        if not self.open:
            raise TransactionError("the transaction has ended")
        self.images[name] = image
        self.changed.add(name)

    def apply(self, name: str, change: Change) -> DataFrame:
        """Takes the table a change of :mod:`dml` leaves and gives the rows it affects."""
        self.write(name, change.table)
        return change.affected


@contextmanager
def transaction(tables: dict[str, DataFrame], folder: str, committed: Callable[[frozenset], None] | None = None) -> Iterator[Transaction]:
    """Changes ``tables`` in place at the end; ``committed`` is then called with the names of those that changed."""
    tx = Transaction(tables)
    try:
        yield tx
    finally:
        tx.open = False
    new = {}
    for name in sorted(tx.changed):
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        tx.images[name].write.parquet(path)
        new[name] = tx.images[name].sparkSession.read.schema(tx.images[name].schema).parquet(path)
    tables.update(new)
    if new and committed:
        committed(frozenset(new))
