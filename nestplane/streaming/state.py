"""State of a running stream as tables: one per micro-batch, folded into snapshots from time to time.

A batch writes its own table under its id, replacing what an earlier attempt of the same batch left.  A snapshot holds
the merged state up to a batch; it counts from the moment its mark is written, which happens last.  Readers take the
newest marked snapshot and the batches after it, so neither a crash between the two nor a replayed batch, folded in already,
counts anything twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, exists


class BatchState:
    """Tables under ``path``, all of one ``schema`` (DDL); snapshots and marks are in folders that readers of ``path`` skip."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def put(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def upto(self) -> int:
        """The last batch folded into a marked snapshot; -1: none."""
        if not exists(self.spark, f"{self.path}/_marks"):
            return -1
        found = self.spark.read.schema("upto bigint").parquet(f"{self.path}/_marks").agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def _batches(self, after: int, until: int | None = None) -> DataFrame:
        where = self.path
        if not exists(self.spark, where):
            return self.spark.createDataFrame([], f"{self.schema}, batch_id bigint")
        found = self.spark.read.schema(f"{self.schema}, batch_id bigint").parquet(where).where(F.col("batch_id") > after)
        return found if until is None else found.where(F.col("batch_id") <= until)

    def _snapshot(self, upto: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/_snapshots/upto={upto}").withColumn("batch_id", F.lit(upto).cast("bigint"))

    def read(self, until: int | None = None) -> DataFrame:
        """The newest snapshot and the batches after it, with ``batch_id`` (a snapshot's: its last)."""
        upto = self.upto()
        tail = self._batches(upto, until)
        return tail if upto < 0 else self._snapshot(upto).unionByName(tail)

    def compact(self, merge: Callable[[DataFrame], DataFrame], upto: int) -> None:
        """Fold everything up to batch ``upto`` into a new snapshot, mark it, and delete what it replaces."""
        before = self.upto()
        if upto <= before:
            return
        merge(self.read(upto)).write.mode("overwrite").parquet(f"{self.path}/_snapshots/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/_marks")
        for old in self._batches(-1, upto).select("batch_id").distinct().collect():
            delete(self.spark, f"{self.path}/batch_id={old[0]}")
        if before >= 0:
            delete(self.spark, f"{self.path}/_snapshots/upto={before}")
