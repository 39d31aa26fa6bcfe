"""Placing points in a fitted tree: paths, coordinates, reconstructions, errors.

A placement is one narrow pass while the nodes fit in a broadcast: each task walks its points down the
tree and emits all levels.  A larger model stays a table: at every level the points are dealt by node once, each task
gets the parameters of its own nodes ahead of their points, emits the points' rows and moves them on in one go.  Neither
way keeps state; a stream goes the first way directly and the second by micro-batches (``streaming.score``).

A point whose dataset the model does not have gets one row, at depth 0 and with a null node and null measures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense, heap
from ..operators.passes import KEYS, Fields, Limits, arrow_schema, by_dataset, ddl, matrix, segments
from ..sources.shared import Workspace

PLACE_FIELDS: Fields = (("dataset_id", "string"), ("point_id", "bigint"), ("depth", "int"), ("node_id", "bigint"))
MEASURES: dict[str, str] = {
    "coord": "array<double>",  # coordinates on the node's plane
    "residual": "double",  # squared distance from the point to the plane
    "rebuilt": "array<double>",  # nearest point of the plane
}


def fitted_pairs(nodes: DataFrame) -> DataFrame:
    """Centers that separated the training points of every split node."""
    return nodes.where(F.col("split_left").isNotNull()).select(
        *KEYS, F.col("split_left").alias("left"), F.col("split_right").alias("right")
    )


def child_pairs(nodes: DataFrame) -> DataFrame:
    """Centers of the two children of every split node; all that is needed to place new points."""
    parent = heap.parent(F.col("node_id")).alias("node_id")
    left, right = (
        nodes.where(heap.side(F.col("node_id")) == s).select("dataset_id", parent, F.col("center").alias(name))
        for s, name in ((0, "left"), (1, "right"))
    )
    return left.join(right, KEYS)


def model_size(nodes: DataFrame) -> dict[str, int]:
    """Bytes of the arrays a placement sends to each task, and the deepest level; one row reaches the driver."""
    doubles = F.size("center") * (F.size("basis") + 3)
    row = nodes.agg(
        F.coalesce(F.sum(doubles.cast("bigint") * 8), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("depth"),
    ).first()
    return row.asDict()


def measure(x: np.ndarray, center: np.ndarray, basis: np.ndarray, wanted: tuple[str, ...], centered: bool):
    """Requested columns for points of one node."""
    c = x - center
    on_plane = c @ basis.T
    out = {}
    if "coord" in wanted:
        coord = on_plane if centered else x @ basis.T
        out["coord"] = list_column(coord)
    if "residual" in wanted:
        off = c - on_plane @ basis
        out["residual"] = pa.array(np.einsum("ij,ij->i", off, off))
    if "rebuilt" in wanted:
        out["rebuilt"] = list_column(center + on_plane @ basis)
    return [out[w] for w in wanted]


def list_column(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def place(
    points: DataFrame,
    nodes: DataFrame,
    wanted: tuple[str, ...] = (),
    pairs: DataFrame | None = None,
    deepest_only: bool = False,
    centered: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """One row per point and level: ``dataset_id, point_id, depth, node_id`` and the ``wanted`` measures.

    ``pairs`` says how a point chooses a child: ``child_pairs(nodes)`` (default, new points) or
    ``fitted_pairs(nodes)`` (the points the tree was fitted on).  ``deepest_only`` keeps the last level.
    """
    pairs = child_pairs(nodes) if pairs is None else pairs
    fields: Fields = PLACE_FIELDS + tuple((w, MEASURES[w]) for w in wanted)
    size = model_size(nodes)
    if size["bytes"] <= limits.broadcast_bytes:
        return place_broadcast(points, nodes, pairs, wanted, fields, deepest_only, centered)
    return place_joined(points, nodes, pairs, wanted, fields, deepest_only, centered, size["depth"])


def place_broadcast(points, nodes, pairs, wanted, fields, deepest_only, centered) -> DataFrame:
    context = points.sparkSession.sparkContext
    columns = (*KEYS, "center", "basis") if wanted else tuple(KEYS)
    known: dict[str, dict[int, tuple]] = {}
    table = nodes.select(*columns).toArrow()
    for row in zip(*(table.column(c).to_pylist() for c in columns)):
        known.setdefault(row[0], {})[row[1]] = as_plane(*row[2:]) if wanted else ()
    ways: dict[str, dict[int, tuple]] = {}
    for row in pairs.select(*KEYS, "left", "right").toArrow().to_pylist():
        ways.setdefault(row["dataset_id"], {})[row["node_id"]] = (np.array(row["left"]), np.array(row["right"]))
    model = context.broadcast((known, ways))
    schema = arrow_schema(fields)

    def run(batches):
        planes, splits = model.value
        for batch in batches:
            for name, part in by_dataset(batch):
                here, steps = planes.get(name, {}), splits.get(name, {})
                if 0 not in here:
                    yield unplaced(part, fields)
                    continue
                x = matrix(part.column("x"))
                todo = [(0, np.arange(len(x)))]
                while todo:
                    node, rows = todo.pop()
                    split = steps.get(node)
                    if not (deepest_only and split is not None):
                        yield placed_rows(part, x, node, rows, here[node])
                    if split is not None:
                        side = dense.sides(x[rows], *split)
                        todo.extend((2 * node + 1 + s, rows[side == s]) for s in (0, 1) if (side == s).any())

    def placed_rows(part, x, node, rows, plane):
        at = pa.array(rows)
        level = (node + 1).bit_length() - 1
        fixed = [
            part.column("dataset_id").take(at),
            part.column("point_id").take(at),
            pa.array(np.full(len(rows), level, dtype=np.int32)),
            pa.array(np.full(len(rows), node, dtype=np.int64)),
        ]
        extra = measure(x[rows], *plane, wanted, centered) if wanted else []
        return pa.RecordBatch.from_arrays(fixed + extra, schema=schema)

    return points.select("dataset_id", "point_id", "x").mapInArrow(run, ddl(fields))


def as_plane(center, basis) -> tuple[np.ndarray, np.ndarray]:
    center = np.asarray(center, dtype=np.float64)
    return center, np.asarray(basis, dtype=np.float64).reshape(-1, center.size)


def unplaced(part: pa.RecordBatch, fields: Fields) -> pa.RecordBatch:
    """Rows of points whose dataset the model does not have."""
    schema, n = arrow_schema(fields), part.num_rows
    given = {"dataset_id": part.column("dataset_id"), "point_id": part.column("point_id"), "depth": pa.array(np.zeros(n, np.int32))}
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


PLACED_ROWS = 1 << 18  # points of a node that one task takes
MANY_NODES = 200_000  # nodes with several parts whose numbers may be broadcast


def place_joined(points, nodes, pairs, wanted, fields, deepest_only, centered, depth) -> DataFrame:
    """Level by level, with one exchange of the points a level; no parameters are broadcast, or copied to every point.

    A node with many points is dealt over as many tasks as they need, and its parameters go to each of these.
    """
    if points.isStreaming:
        raise ValueError("the model is too large for one narrow pass; score_stream places micro-batches")
    work = Workspace(points.sparkSession, "place")
    step_fields: Fields = fields + (("place", "bigint"), ("x", "array<double>"))
    schema = arrow_schema(step_fields)

    def step(batches):
        """Points of a node come after its parameters (kind 0): each gives its row, and where it goes next with its vector."""
        known: dict[tuple[str, int], tuple] = {}
        for batch in batches:
            known = dict(list(known.items())[-1:])  # of the node whose points may go on
            for name, part in by_dataset(batch):
                kinds, place = part.column("kind").to_numpy(), part.column("node_id").to_numpy()
                for at in np.flatnonzero(kinds == 0).tolist():
                    known[name, int(place[at])] = tuple(part.column(c)[at].as_py() for c in ("center", "basis", "left", "right"))
                for node, rows in segments(np.where(kinds == 1, place, -1)):
                    if node >= 0:
                        yield from placed(part.take(pa.array(rows)), name, node, known.get((name, node)))

    def placed(chunk, name, node, params):
        n, x = chunk.num_rows, matrix(chunk.column("x"))
        extra = [pa.nulls(n, pa.int64()), pa.nulls(n, schema.field("x").type)]
        if params is None:
            rows = unplaced(chunk, fields)
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], schema=schema)
            return
        center, basis, left, right = params
        if not (deepest_only and left is not None):
            level = pa.array(np.full(n, (node + 1).bit_length() - 1, dtype=np.int32))
            fixed = [chunk.column("dataset_id"), chunk.column("point_id"), level, chunk.column("node_id")]
            measures = measure(x, *as_plane(center, basis), wanted, centered) if wanted else []
            yield pa.RecordBatch.from_arrays([*fixed, *measures, *extra], schema=schema)
        if left is not None:
            side = dense.sides(x, np.asarray(left), np.asarray(right))
            fixed = [chunk.column("dataset_id"), chunk.column("point_id")]
            none = [pa.nulls(n, f.type) for f in list(schema)[2 : len(fields)]]
            yield pa.RecordBatch.from_arrays([*fixed, *none, pa.array(2 * node + 1 + side), chunk.column("x")], schema=schema)

    current = points.select("dataset_id", F.lit(0).cast("bigint").alias("node_id"), "point_id", "x")
    out = None
    for level in range(depth + 1):
        here = nodes.where(F.col("depth") == level).select(*KEYS, "center", "basis").join(pairs.select(*KEYS, "left", "right"), KEYS, "left")
        counts = current.groupBy(*KEYS).agg(F.ceil(F.count("*") / PLACED_ROWS).cast("int").alias("parts"))
        large = work.write(counts.where("parts > 1"), f"large{level}")
        large = F.broadcast(large) if large.count() <= MANY_NODES else large
        parts = F.coalesce("parts", F.lit(1))
        none = {"point_id": "cast(null as bigint)", "x": "cast(null as array<double>)"}
        heads = here.join(large, KEYS, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        heads = heads.withColumn("kind", F.lit(0)).withColumns({c: F.expr(e) for c, e in none.items()})
        empty = {"center": "array<double>", "basis": "array<array<double>>", "left": "array<double>", "right": "array<double>"}
        rows = current.join(large, KEYS, "left").withColumn("part", F.pmod(F.xxhash64("point_id"), parts).cast("int")).drop("parts")
        rows = rows.withColumn("kind", F.lit(1)).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
        dealt = heads.unionByName(rows).repartition(*KEYS, "part").sortWithinPartitions(*KEYS, "part", "kind")
        done = work.write(dealt.mapInArrow(step, ddl(step_fields)), f"level{level}")
        emitted = done.where("place is null").select(*[n for n, _ in fields])
        out = emitted if out is None else out.unionByName(emitted)
        current = done.where("place is not null").select("dataset_id", F.col("place").alias("node_id"), "point_id", "x")
    return out


def project_points(points: DataFrame, nodes: DataFrame, centered: bool = True, limits: Limits = Limits()) -> DataFrame:
    """Coordinates of new points at every level, walking to the nearer child center; ties go left."""
    return place(points, nodes, ("coord",), centered=centered, limits=limits)


def leaf_of_point(points: DataFrame, nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return place(points, nodes, deepest_only=True, limits=limits)


def assignments(points: DataFrame, nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Node of every fitted point at every level."""
    return place(points, nodes, pairs=fitted_pairs(nodes), limits=limits)


def coords(points: DataFrame, nodes: DataFrame, centered: bool = True, limits: Limits = Limits()) -> DataFrame:
    """Coordinates of every fitted point at every level."""
    return place(points, nodes, ("coord",), pairs=fitted_pairs(nodes), centered=centered, limits=limits)


def reconstruct(points: DataFrame, nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Nearest point of the node plane for every fitted point at every level."""
    return place(points, nodes, ("rebuilt",), pairs=fitted_pairs(nodes), limits=limits)


def level_error(points: DataFrame, nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Points, mean squared distance to their plane, by level."""
    placed = place(points, nodes, ("residual",), pairs=fitted_pairs(nodes), limits=limits)
    return placed.groupBy("dataset_id", "depth").agg(F.count("*").alias("n"), F.avg("residual").alias("mse"))
