"""Saving, loading and exporting fitted trees as parquet.

A saved model is a folder of tables of its own, and counts from the moment its row is in the manifest, which is written last.  A
reader takes the newest model of the manifest, so it sees no half-written one and no mixture of two.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.passes import KEYS, ddl
from ..plans.tree import NODE_FIELDS
from .shared import delete, exists

COORD_FIELDS = (
    ("dataset_id", "string"),
    ("point_id", "bigint"),
    ("depth", "int"),
    ("node_id", "bigint"),
    ("coord", "array<double>"),
)


MANIFEST = "model string, saved bigint, coords boolean"


def save_model(path: str, nodes: DataFrame, coords: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Write ``nodes`` and, if given, ``coords``, each laid out by dataset so that reads can prune.

    ``mode`` is ``errorifexists`` or ``overwrite``; the model overwritten is there until the new one is committed.
    """
    spark, before = nodes.sparkSession, committed(nodes.sparkSession, path)
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode {mode}")
    if before is not None and mode == "errorifexists":
        raise ValueError(f"{path} holds a model")
    name = f"model-{uuid.uuid4().hex}"
    by_dataset(nodes.select(*[n for n, _ in NODE_FIELDS])).write.partitionBy("dataset_id").parquet(f"{path}/{name}/nodes")
    if coords is not None:
        by_dataset(coords).write.partitionBy("dataset_id").parquet(f"{path}/{name}/coords")
    saved = max(time.time_ns(), before["saved"] + 1 if before else 0)
    spark.createDataFrame([(name, saved, coords is not None)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    if before is not None:
        delete(spark, f"{path}/{before['model']}")


def committed(spark: SparkSession, path: str) -> dict | None:
    """The newest row of the manifest under ``path``."""
    if not exists(spark, f"{path}/manifest"):
        return None
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("saved")).head(1)
    return rows[0].asDict() if rows else None


def by_dataset(df: DataFrame) -> DataFrame:
    """Rows of a dataset brought together before a partitioned write, so that files stay few.

    This is a rebalance, not a hash partitioning: AQE cuts a large dataset into many tasks.
    """
    return df.hint("rebalance", "dataset_id")


def _read(spark: SparkSession, path: str, fields) -> DataFrame:
    wanted = StructType.fromDDL(ddl(fields))
    df = spark.read.schema(wanted).parquet(path)
    stored = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    wrong = {n: stored.get(n) for n, t in fields if n != "dataset_id" and stored.get(n) != t}
    if wrong or "dataset_id" not in stored:
        raise ValueError(f"{path} does not hold the expected columns: {wrong or 'dataset_id'}")
    return df.select(*[n for n, _ in fields])


def _committed(spark: SparkSession, path: str) -> dict:
    found = committed(spark, path)
    if found is None:
        raise ValueError(f"{path} holds no model that was saved to its end")
    return found


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Centers, bases and splits; enough to place points without the training data."""
    return _read(spark, f"{path}/{_committed(spark, path)['model']}/nodes", NODE_FIELDS)


def load_coords(spark: SparkSession, path: str) -> DataFrame:
    found = _committed(spark, path)
    if not found["coords"]:
        raise ValueError(f"the model in {path} was saved without coordinates")
    return _read(spark, f"{path}/{found['model']}/coords", COORD_FIELDS)


def vector_rows(nodes: DataFrame, coords: DataFrame) -> DataFrame:
    """Centers, bases and coordinates as long rows, one number each.

    ``component`` is 0 for a center, the basis row for a basis and the point id for coordinates.
    """
    keyed = [F.col(k) for k in KEYS]

    def numbers(kind: str, component, x):
        return [*keyed, F.lit(kind).alias("kind"), component.cast("bigint").alias("component"), F.posexplode(x).alias("pos", "value")]

    centers = nodes.select(*numbers("center", F.lit(0), F.col("center")))
    bases = nodes.select(*KEYS, F.posexplode("basis").alias("k", "row")).select(*numbers("basis", F.col("k") + 1, F.col("row")))
    points = coords.select(*numbers("coord", F.col("point_id"), F.col("coord")))
    rows = centers.unionByName(bases).unionByName(points)
    return rows.select(*KEYS, "kind", "component", (F.col("pos") + 1).cast("int").alias("dim"), "value")


def export_vectors(path: str, nodes: DataFrame, coords: DataFrame, fmt: str = "parquet", mode: str = "append") -> None:
    """Append the long rows to ``path``, one folder per dataset, as parquet or CSV."""
    by_dataset(vector_rows(nodes, coords)).write.mode(mode).partitionBy("dataset_id").format(fmt).save(path)
