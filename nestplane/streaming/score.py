"""Scoring arriving points against a saved tree.  Stateless, so it is the batch placement on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.passes import Limits
from ..plans.score import model_size, project_points


def score_stream(points: DataFrame, nodes: DataFrame, path: str, checkpoint: str, limits: Limits = Limits(), **trigger) -> StreamingQuery:
    """Write coordinates at every level to parquet under ``path``.

    A model that fits a broadcast places the stream in one narrow pass, and the file sink commits each batch once. With a larger one
    every micro-batch is placed like a table, dealt by node, into a folder ``batch_id`` that a replay of the batch replaces.
    """
    trigger = trigger or {"availableNow": True}
    if model_size(nodes)["bytes"] <= limits.broadcast_bytes:
        writer = project_points(points, nodes, limits=limits).writeStream.format("parquet").option("path", path).outputMode("append")
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            project_points(batch, nodes, limits=limits).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        writer = points.writeStream.foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
