"""Running rank-k SVD of arriving points, for points too wide to keep a scatter matrix of.

Each micro-batch leaves its own merged sketch; sketches of all batches merge in the order of batches, and every so many
batches they are folded into a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.passes import Limits, ddl
from ..operators.sketch import SKETCH_FIELDS, merge_sketches, sketch
from .state import BatchState


def _state(spark: SparkSession, path: str) -> BatchState:
    return BatchState(spark, path, ddl(SKETCH_FIELDS))


def _merged(stored: DataFrame, k: int) -> DataFrame:
    return merge_sketches(stored.withColumn("block", F.col("batch_id")).drop("batch_id"), k)


def run_sketches(
    points: DataFrame, path: str, checkpoint: str, k: int, limits: Limits = Limits(), compact_every: int = 64, **trigger
) -> StreamingQuery:
    """Keep one sketch of ``k`` rows per dataset and batch under ``path``; every ``compact_every`` batches they become one (0: never)."""
    state = _state(points.sparkSession, path)

    def save(batch: DataFrame, batch_id: int) -> None:
        state.put(sketch(batch, k), batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            state.compact(lambda stored: _merged(stored, k), batch_id)

    writer = points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def merged_sketch(spark: SparkSession, path: str, k: int, limits: Limits = Limits()) -> DataFrame:
    """One sketch per dataset over all batches."""
    return _merged(_state(spark, path).read(), k)
