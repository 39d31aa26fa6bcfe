"""2-means for all nodes of a level at once.

Seeds are the point farthest from the node center and the point farthest from that one.  Then each
step assigns every point to the nearer center and recenters; after ``steps`` of them one last
assignment decides the sides.  Every step is one pass over the points of the nodes that still change, whatever
their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import heap
from .passes import (
    FAR_FIELDS,
    KEYS,
    FarFold,
    Fields,
    Front,
    Limits,
    NodeTable,
    SideFold,
    SumFold,
    arrow_schema,
    batch_of,
    farthest_held,
    farthest_of,
    node_pass,
    pin,
    pin_totals,
    table_records,
)
from .points import validate_points
from ..sources.shared import Workspace

STEPS = 10


def level_bytes(rows: int, dims: int, vectors: int = 1) -> int:
    """Upper bound of a node table of that many double vectors."""
    return rows * (dims * 8 * vectors + 96)


CENTER_FIELDS: Fields = (("dataset_id", "string"), ("node_id", "bigint"), ("n", "bigint"), ("center", "array<double>"))
PAIR_FIELDS: Fields = (("dataset_id", "string"), ("node_id", "bigint"), ("left", "array<double>"), ("right", "array<double>"))
SIDE_FIELDS: Fields = PAIR_FIELDS + (("n_left", "bigint"), ("n_right", "bigint"), ("mark", "bigint"))


def root_centers(front: Front, datasets: int, dims: int) -> NodeTable:
    """``(dataset_id, node_id=0, n, center)`` of every dataset."""
    totals = pin_totals(node_pass(front, SumFold()), level_bytes(datasets, dims), front, "roots")
    return totals.map(center_rows, CENTER_FIELDS)


def center_rows(row: dict):
    yield row["dataset_id"], row["node_id"], row["n"], np.asarray(row["total"]) / row["n"]


def seeds(front: Front, centers: NodeTable, nbytes: int, tag: str) -> NodeTable:
    """Starting pair of every node that has two different points.  Each is found, with its vector, by one pass."""

    def far(params: NodeTable, name: str) -> NodeTable:
        partials = node_pass(front, FarFold(), params)
        if front.gathers(nbytes):
            return NodeTable(partials.sparkSession, FAR_FIELDS, held=farthest_held(partials.toArrow()))
        return pin(farthest_of(partials), FAR_FIELDS, nbytes, front.limits, front.work, f"{tag}-{name}")

    first = far(centers, "far0").map(lambda r: [(r["dataset_id"], r["node_id"], 0, r["x"])], CENTER_FIELDS)
    other = far(first, "far1").map(lambda r: [(r["dataset_id"], r["node_id"], 0, r["x"])] if r["d2"] > 0 else [], CENTER_FIELDS)
    if first.held is not None and other.held is not None:
        left = {(r["dataset_id"], r["node_id"]): r["center"] for r in table_records(first.held)}
        rows = [(r["dataset_id"], r["node_id"], left[r["dataset_id"], r["node_id"]], r["center"]) for r in table_records(other.held)]
        return NodeTable(first.spark, PAIR_FIELDS, held=pa.Table.from_batches([batch_of(rows, PAIR_FIELDS)]))
    both = first.df.select(*KEYS, F.col("center").alias("left")).join(other.df.select(*KEYS, F.col("center").alias("right")), KEYS)
    return pin(both, PAIR_FIELDS, 2 * nbytes, front.limits, front.work, f"{tag}-seed1")


def recenter(front: Front, pairs: NodeTable, nbytes: int, name: str) -> NodeTable:
    """Assign to the nearer of each pair; sizes, fingerprint and means of both sides."""
    totals = pin_totals(node_pass(front, SideFold(), pairs), 2 * nbytes, front, name)
    return totals.map(side_rows, SIDE_FIELDS)


def side_rows(row: dict):
    v = np.asarray(row["total"])
    left, right = np.split(v[:-2], 2)
    n_left, n_right = int(v[-2]), int(v[-1])
    if n_left and n_right:
        yield row["dataset_id"], row["node_id"], left / n_left, right / n_right, n_left, n_right, row["mark"]


def children_of(sides: NodeTable) -> NodeTable:
    """Two rows per split node: the child's id, size and mean."""

    def rows(r: dict):
        yield r["dataset_id"], 2 * r["node_id"] + 1, r["n_left"], r["left"]
        yield r["dataset_id"], 2 * r["node_id"] + 2, r["n_right"], r["right"]

    return sides.map(rows, CENTER_FIELDS)


def same_assignment(a: NodeTable, b: NodeTable) -> bool:
    """Whether two steps put the same points on the left of every node (sizes and fingerprints agree)."""
    columns = [*KEYS, "n_left", "n_right", "mark"]
    return a.df.select(*columns).exceptAll(b.df.select(*columns)).isEmpty()


def settled(before: NodeTable, after: NodeTable) -> set[tuple[str, int]]:
    """Nodes whose points stayed on their sides, from two held steps."""
    columns = [*KEYS, "n_left", "n_right", "mark"]
    rows = [set(zip(*(t.held.column(c).to_pylist() for c in columns))) for t in (before, after)]
    return {r[:2] for r in rows[0] & rows[1]}


def two_means(front: Front, centers: NodeTable, rows: int, dims: int, steps: int = STEPS, tag: str = "split"):
    """Pairs of centers that separate each node, and the sizes and means of the resulting sides.

    A node whose points all stayed where they were is done; later steps pass over the other nodes only. (Node tables
    too large to hold go on together until no node changes.)
    """
    nbytes = level_bytes(rows, dims)
    pairs = seeds(front, centers, nbytes, tag)
    if pairs.count() == 0:
        return pairs, NodeTable(pairs.spark, SIDE_FIELDS, held=arrow_schema(SIDE_FIELDS).empty_table())
    before, done = None, []
    for step in range(steps + 1):
        after = recenter(front, pairs, nbytes, f"{tag}-step{step}")
        if after.held is None or pairs.held is None:
            if step == steps or (before is not None and same_assignment(before, after)):
                return pairs, after
        else:
            still = settled(before, after) if before is not None and step < steps else set()
            over = lambda r: step == steps or (r["dataset_id"], r["node_id"]) in still  # noqa: B023,E731
            if step == steps or still:
                done.append((pairs.where(over), after.where(over)))
                after = after.where(lambda r: not over(r))  # noqa: B023
            if not after.held.num_rows:
                return joined([p for p, _ in done], PAIR_FIELDS), joined([a for _, a in done], SIDE_FIELDS)
        before = pairs = after
    raise AssertionError("unreachable")


def joined(tables: list[NodeTable], fields: Fields) -> NodeTable:
    names = [n for n, _ in fields]
    return NodeTable(tables[0].spark, fields, held=pa.concat_tables([t.held.select(names) for t in tables]))


def split_roots(points: DataFrame, steps: int = STEPS, limits: Limits = Limits()):
    """2-means of each dataset as one node: the points' front, the separating pairs, the resulting sides."""
    shape = checked_size(points)
    front = Front(points, limits, Workspace(points.sparkSession, "split"), tasks=shape["tasks"])
    centers = root_centers(front, shape["datasets"], shape["dims"])
    return front, *two_means(front, centers, shape["datasets"], shape["dims"], steps)


def size_of(points: DataFrame) -> dict[str, int]:
    """Number of datasets, the largest one's rows and the widest dimension; one row reaches the driver."""
    per = points.groupBy("dataset_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"))
    row = per.agg(
        F.count("*").alias("datasets"), F.coalesce(F.max("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("d"), F.lit(0)).alias("dims")
    ).first()
    return row.asDict()


def checked_size(points: DataFrame) -> dict[str, int]:
    """``size_of`` points that are sound, with about the ``tasks`` of a pass; ``validate_points`` says what raises."""
    row = validate_points(points).agg(
        F.count("*").alias("datasets"),
        F.coalesce(F.max("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.max("dims"), F.lit(0)).alias("dims"),
        F.coalesce(F.max("tasks"), F.lit(0)).alias("tasks"),
    ).first()
    return row.asDict()


def two_means_centers(points: DataFrame, steps: int = STEPS, limits: Limits = Limits()) -> DataFrame:
    """Trained centers: the means after the last recentering, one row per side."""
    _, pairs, _ = split_roots(points, steps, limits)
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("left").alias("center")),
            F.struct(F.lit(1).alias("side"), F.col("right").alias("center")),
        )
    ).alias("s")
    return pairs.df.select(*KEYS, sides).select(*KEYS, F.col("s.side").alias("side"), F.col("s.center").alias("center"))


def two_means_split(points: DataFrame, steps: int = STEPS, limits: Limits = Limits()) -> DataFrame:
    """Every point with the child node it belongs to.  Points of an unsplittable set stay in node 0."""
    front, pairs, _ = split_roots(points, steps, limits)
    return front.extend(pairs, "moved").located()


def two_means_assign(points: DataFrame, steps: int = STEPS, limits: Limits = Limits()) -> DataFrame:
    """Side (0 or 1) of every point."""
    moved = two_means_split(points, steps, limits)
    return moved.select("dataset_id", "point_id", heap.side(F.col("node_id")).alias("side"))


def split_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("dataset_id", "side").agg(F.count("*").alias("n"))
