"""Sums, centers and comparison of node planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import heap
from ..functions import vectors as V
from .passes import KEYS, Front, Limits, SumFold, attach, node_pass, node_totals
from ..sources.shared import Workspace

PRUNE_COSINE = 0.99999  # siblings whose planes agree this closely are dropped


def vector_sums(points: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Row count and vector sum per node; ``node_id`` is taken from the points if they carry one."""
    placed = "node_id" in points.columns
    front = Front(points, limits, Workspace(points.sparkSession, "sums"), placed=placed)
    return node_totals(node_pass(front, SumFold())).select(*KEYS, "n", "total")


def node_centers(points: DataFrame, limits: Limits = Limits()) -> DataFrame:
    sums = vector_sums(points, limits)
    return sums.select(*KEYS, "n", V.scale(F.col("total"), F.lit(1.0) / F.col("n")).alias("center"))


def center_points(located: DataFrame, centers: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Points of each node minus the node's center; a node without one is an error."""
    alone = F.raise_error(F.concat(F.lit("no center for node "), F.col("node_id"))).cast("array<double>")
    return attach(located, centers.select(*KEYS, "center"), KEYS, "left", limits).select(
        *KEYS, "point_id", V.subtract(F.col("x"), F.coalesce("center", alone)).alias("x")
    )


def node_counts(located: DataFrame) -> DataFrame:
    return located.groupBy(*KEYS).agg(F.count("*").alias("n"))


def node_shapes(located: DataFrame) -> DataFrame:
    """Rows and columns of every node."""
    return located.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max(F.size("x")).cast("int").alias("dims"))


def level_max(nodes: DataFrame) -> DataFrame:
    """Size of the largest node of each level."""
    return nodes.groupBy("dataset_id", "depth").agg(F.max("n").alias("max_n"))


def siblings(nodes: DataFrame) -> DataFrame:
    """Left and right child side by side, one row per split parent."""
    left = nodes.where(heap.side(F.col("node_id")) == 0).select(
        "dataset_id", heap.parent(F.col("node_id")).alias("node_id"), F.col("basis").alias("left_basis")
    )
    right = nodes.where(heap.side(F.col("node_id")) == 1).select(
        "dataset_id", heap.parent(F.col("node_id")).alias("node_id"), F.col("basis").alias("right_basis")
    )
    return left.join(right, KEYS)


def basis_traces(nodes: DataFrame) -> DataFrame:
    """Traces of the products of sibling bases: left-right, left-left and right-right."""
    a, b = F.col("left_basis"), F.col("right_basis")
    return siblings(nodes).select(
        *KEYS,
        V.trace_of_product(a, b).alias("trace_ab"),
        V.trace_of_product(a, a).alias("trace_aa"),
        V.trace_of_product(b, b).alias("trace_bb"),
    )


def sibling_cosine(nodes: DataFrame) -> DataFrame:
    """Signed cosine between the planes of two siblings, keyed by their parent; NULL if a plane is empty."""
    size = F.sqrt(F.col("trace_aa") * F.col("trace_bb"))
    return basis_traces(nodes).select(*KEYS, F.when(size > 0, F.col("trace_ab") / size).alias("split_cosine"))


def keep_split(cosine: Column, prune: float = PRUNE_COSINE) -> Column:
    """Whether a split stays: its planes differ, or cannot be compared."""
    return F.coalesce(cosine < F.lit(prune), F.lit(True))


def prune_splits(cosines: DataFrame, prune: float = PRUNE_COSINE) -> DataFrame:
    """Splits that stay."""
    return cosines.where(keep_split(F.col("split_cosine"), prune))
