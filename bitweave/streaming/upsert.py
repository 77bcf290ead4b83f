"""Indexes that follow a stream: micro-batches are upserted into versions of a table, and scored on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitweave.operators.setjoin import last_versions


class IndexTable:
    """A table in numbered versions; a batch writes the next one, so a batch that is repeated writes the same again."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key, self.version = spark, path, key, -1

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{self.version}") if self.version >= 0 else None

    def upsert(self, batch: DataFrame, number: int, order: str) -> None:
        """The batch's last row of an id replaces the table's row."""
        new = last_versions(batch, order, self.key)
        old = self.read()
        out = new if old is None else old.join(new.select(self.key), self.key, "left_anti").unionByName(new)
        out.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        self.version = number


def follow(stream: DataFrame, table: IndexTable, order: str, checkpoint: str, then: Callable[[DataFrame, IndexTable], None] | None = None):
    """Starts a query that upserts every micro-batch, then calls ``then(batch, table)``."""

    def step(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, order)
        if then:
            then(batch, table)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
