"""Reading point clouds and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = "all"


def as_points(df: DataFrame, point_id: str | Column, x: str | Column, dataset_id: Column | None = None) -> DataFrame:
    """Any table as ``points (dataset_id STRING, point_id BIGINT, x ARRAY<DOUBLE>)``."""
    dataset_id = F.lit(DATASET) if dataset_id is None else dataset_id
    point_id = F.col(point_id) if isinstance(point_id, str) else point_id
    x = F.col(x) if isinstance(x, str) else x
    return df.select(
        dataset_id.cast("string").alias("dataset_id"),
        point_id.cast("bigint").alias("point_id"),
        x.cast("array<double>").alias("x"),
    )


def read_points(
    spark: SparkSession,
    path: str | list[str],
    point_id: str = "point_id",
    x: str | list[str] = "x",
    dataset_id: str | None = None,
    fmt: str = "parquet",
    schema: str | None = None,
    **options: str,
) -> DataFrame:
    """Load a cloud.  ``x`` is an array column, or a list of numeric columns (for text formats)."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    vector = F.array(*[F.col(c).cast("double") for c in x]) if isinstance(x, list) else F.col(x)
    return as_points(df, point_id, vector, F.col(dataset_id) if dataset_id else None)


def as_frames(df: DataFrame, traj_id: Column, frame_id: Column, atoms: Column) -> DataFrame:
    """Any table as ``frames (traj_id STRING, frame_id BIGINT, atoms ARRAY<ARRAY<DOUBLE>>)``."""
    return df.select(
        traj_id.cast("string").alias("traj_id"),
        frame_id.cast("bigint").alias("frame_id"),
        atoms.cast("array<array<double>>").alias("atoms"),
    )


def atoms_of(x: Column, width: int = 3) -> Column:
    """Cut a flat vector into rows of ``width``, the last one filled with zeros."""
    count = F.ceil(F.size(x) / F.lit(width)).cast("int")
    filled = F.concat(x, F.array_repeat(F.lit(0.0), F.pmod(-F.size(x), F.lit(width))))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(filled, i * width + 1, width))


def flatten_frames(frames: DataFrame) -> DataFrame:
    """Frames as points: the trajectory is the dataset, the atoms one long vector."""
    return as_points(frames, "frame_id", F.flatten("atoms"), F.col("traj_id"))
