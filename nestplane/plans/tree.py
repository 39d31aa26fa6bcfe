"""Fitting the tree of planes.

The driver loops over levels, never over nodes, and sees only node rows within a size bound.  After a level the
points of the nodes that are still split are written once, clustered by node, and the next level reads
these only.  Nodes small enough for one task are set aside on the way, in the same write, and finished
together at the end, in one grouped pass, so an oversized node never holds up or joins that pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense, heap
from ..operators.passes import KEYS, Fields, Front, Limits, NodeTable, batch_of, ddl, matrix, pin
from ..operators.planes import PRUNE_COSINE, keep_split, sibling_cosine
from ..operators.split import CENTER_FIELDS, STEPS, checked_size, children_of, level_bytes, root_centers, two_means
from ..operators.svd import planes
from ..sources.shared import Workspace

NODE_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("parent_id", "bigint"),
    ("depth", "int"),
    ("side", "int"),
    ("n", "bigint"),
    ("center", "array<double>"),
    ("basis", "array<array<double>>"),
    ("singular_values", "array<double>"),
    ("split_cosine", "double"),
    ("is_leaf", "boolean"),
    ("split_left", "array<double>"),
    ("split_right", "array<double>"),
)
NODE_COLUMNS = [n for n, _ in NODE_FIELDS]
ROW_FIELDS = NODE_FIELDS[:9]  # known as soon as a node's plane is fitted
SPLIT_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("split_left", "array<double>"),
    ("split_right", "array<double>"),
    ("split_cosine", "double"),
    ("kept", "boolean"),
)


@dataclass(frozen=True)
class Settings:
    """What to fit: plane dimension, deepest level, prune threshold, 2-means steps."""

    d: int
    max_depth: int
    prune: float = PRUNE_COSINE
    steps: int = STEPS


def fit(
    points: DataFrame,
    d: int,
    max_depth: int,
    prune: float = PRUNE_COSINE,
    steps: int = STEPS,
    limits: Limits = Limits(),
) -> DataFrame:
    """Nodes of the tree of every dataset in ``points (dataset_id, point_id, x)``.

    The result is a written table.  Points are checked first (``validate_points`` says what raises), the same whatever
    the limits.  ``split_left`` / ``split_right`` are the centers that separated a
    node's points; ``center`` is the mean of the points that ended up in it.
    """
    what = Settings(d, max_depth, prune, steps)
    work = Workspace(points.sparkSession, "fit")
    shape = checked_size(points)
    dims = shape["dims"]
    front = Front(points, limits, work, tasks=shape["tasks"])
    if local_size(shape["rows"], dims, limits):
        return work.write(finish_locally(front.located(), what), "nodes")

    small = lambda row: local_size(row["n"], dims, limits)
    large = lambda row: not small(row)
    roots = root_centers(front, shape["datasets"], dims)
    waiting = [roots.where(small)]
    aside = [front.located().join(waiting[0].df.select(*KEYS), KEYS, "left_semi")] if waiting[0].count() else []
    live, rows = settle(roots.where(large), dims, limits, work, "level0-live")
    top = node_rows(live.df, planes(front, live, d))
    levels = [pin(top, ROW_FIELDS, level_bytes(rows, dims, d + 1), limits, work, "level0").df]
    splits: list[DataFrame] = []
    live = live.where(lambda row: row["n"] > 1)
    rows = live.count()
    depth = 0
    while depth < max_depth and rows:
        depth += 1
        step = expand_level(front, live, rows, dims, what, depth)
        front = step.front
        levels.append(step.nodes)
        splits.append(step.splits)
        if depth < max_depth:
            opened = pin(step.nodes.where("n > 1"), CENTER_FIELDS, level_bytes(2 * rows, dims), limits, work, f"level{depth}-open")
            put_aside = opened.where(small)
            live, rows = settle(opened.where(large), dims, limits, work, f"level{depth}-live")
            if rows or put_aside.count():
                front, left = front.settle(live, put_aside, dims, f"level{depth}-points")
                if left is not None:
                    waiting.append(put_aside)
                    aside.append(left)
    nodes = work.write(assemble(levels, splits, waiting, aside, what), "nodes")
    front.release()
    if front.placed:
        work.drop(front.points)
    return nodes


def settle(nodes: NodeTable, dims: int, limits: Limits, work: Workspace, name: str) -> tuple[NodeTable, int]:
    """Count a filtered node table, and hold it if what is left allows that."""
    rows = nodes.count()
    if nodes.held is None:
        nodes = pin(nodes.df, nodes.fields, level_bytes(rows, dims), limits, work, name)
    return nodes, rows


def local_size(rows: int, dims: int, limits: Limits) -> bool:
    return rows <= limits.local_rows and rows * dims * 8 <= limits.local_bytes


def node_rows(stats: DataFrame, planes_df: DataFrame) -> DataFrame:
    """Node columns known once a node has its size, center and plane."""
    node = F.col("node_id")
    return stats.select(*KEYS, "n", "center").join(planes_df, KEYS).select(
        *KEYS,
        heap.parent(node).alias("parent_id"),
        heap.depth(node).alias("depth"),
        heap.side(node).alias("side"),
        "n",
        "center",
        "basis",
        "singular_values",
    )


@dataclass(frozen=True)
class Level:
    front: Front  # points moved to the new children
    nodes: DataFrame  # children that were kept
    splits: DataFrame  # every split tried, with its cosine and whether it was kept


def expand_level(front: Front, live: NodeTable, rows: int, dims: int, what: Settings, depth: int) -> Level:
    """Split every live node, fit a plane to each child, and drop the splits whose planes agree."""
    work, tag = front.work, f"level{depth}"
    pairs, sides = two_means(front, live, rows, dims, what.steps, tag)
    moved = front.extend(pairs, f"{tag}-moved")
    children = children_of(sides)
    rows_of = node_rows(children.df, planes(moved, children, what.d))
    fitted = pin(rows_of, ROW_FIELDS, level_bytes(2 * rows, dims, what.d + 1), front.limits, work, f"{tag}-fitted").df
    tried = sibling_cosine(fitted).join(pairs.df, KEYS).select(
        *KEYS,
        F.col("left").alias("split_left"),
        F.col("right").alias("split_right"),
        "split_cosine",
        keep_split(F.col("split_cosine"), what.prune).alias("kept"),
    )
    splits = pin(tried, SPLIT_FIELDS, level_bytes(rows, dims, 2), front.limits, work, f"{tag}-splits").df
    parents = splits.where("kept").select("dataset_id", F.col("node_id").alias("parent_id"))
    return Level(moved, fitted.join(parents, ["dataset_id", "parent_id"], "left_semi"), splits)


def expand_roots(points: DataFrame, d: int, prune: float = PRUNE_COSINE, steps: int = STEPS, limits: Limits = Limits()):
    """One level under every root: the children kept, as node rows."""
    work = Workspace(points.sparkSession, "expand")
    shape = checked_size(points)
    front = Front(points, limits, work, tasks=shape["tasks"])
    roots = root_centers(front, shape["datasets"], shape["dims"]).where(lambda row: row["n"] > 1)
    return expand_level(front, roots, roots.count(), shape["dims"], Settings(d, 1, prune, steps), 1).nodes


def assemble(levels: list[DataFrame], splits: list[DataFrame], waiting: list[NodeTable], aside: list[DataFrame], what: Settings) -> DataFrame:
    """All node rows, leaves marked; the points set aside are finished here and their nodes' rows replaced."""
    top = reduce(DataFrame.unionByName, levels)
    if splits:
        tried = reduce(DataFrame.unionByName, splits)
        kept = F.coalesce(F.col("kept"), F.lit(False))
        top = top.join(tried, KEYS, "left").select(
            *top.columns,
            "split_cosine",
            (~kept).alias("is_leaf"),
            F.when(kept, F.col("split_left")).alias("split_left"),
            F.when(kept, F.col("split_right")).alias("split_right"),
        )
    else:
        top = top.selectExpr(
            "*",
            "cast(null as double) as split_cosine",
            "true as is_leaf",
            "cast(null as array<double>) as split_left",
            "cast(null as array<double>) as split_right",
        )
    waiting = [w for w in waiting if w.count()]
    if not waiting:
        return top.select(*NODE_COLUMNS)
    keys = reduce(DataFrame.unionByName, [w.df.select(*KEYS) for w in waiting])
    finished = finish_locally(reduce(DataFrame.unionByName, [p.select("dataset_id", "node_id", "point_id", "x") for p in aside]), what)
    return top.join(keys, KEYS, "left_anti").select(*NODE_COLUMNS).unionByName(finished)


# --- one bounded node in one task ---------------------------------------------------------------


def finish_locally(located: DataFrame, what: Settings) -> DataFrame:
    """Grow the whole subtree under every node of ``located``, each in one task."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("point_id")
        x, ids = matrix(table.column("x").combine_chunks()), table.column("point_id").to_numpy()
        name, top = table.column("dataset_id")[0].as_py(), table.column("node_id")[0].as_py()
        return pa.Table.from_batches([batch_of(list(subtree(name, top, x, ids, what)), NODE_FIELDS)])

    return located.groupBy(*KEYS).applyInArrow(grow, ddl(NODE_FIELDS))


def subtree(name: str, top: int, x: np.ndarray, ids: np.ndarray, what: Settings):
    """Node rows of the tree over ``x``, the same way the level-wide passes would give them."""
    center = x.mean(axis=0)
    todo = [(top, np.arange(len(x)), center, *dense.plane_of_rows(x - center, what.d))]
    while todo:
        node, rows, center, values, basis = todo.pop()
        depth = (node + 1).bit_length() - 1
        cosine, pair = None, (None, None)
        found = halves(x[rows], ids[rows], center, what.steps) if depth < what.max_depth and len(rows) > 1 else None
        if found is not None:
            left, right, side = found
            parts = [rows[side == s] for s in (0, 1)]
            means = [x[p].mean(axis=0) for p in parts]
            fits = [dense.plane_of_rows(x[p] - m, what.d) for p, m in zip(parts, means)]
            cosine = dense.basis_cosine(fits[0][1], fits[1][1])
            if cosine is None or cosine < what.prune:
                pair = (left, right)
                todo.extend((2 * node + 1 + s, parts[s], means[s], *fits[s]) for s in (0, 1))
        yield (
            name,
            node,
            (node - 1) // 2 if node else None,
            depth,
            1 - node % 2 if node else None,
            len(rows),
            center,
            list(basis),
            values,
            cosine,
            pair[0] is None,
            *pair,
        )


def halves(x: np.ndarray, ids: np.ndarray, center: np.ndarray, steps: int):
    """Separating centers and side of each row; None when all rows are equal."""
    left = x[dense.farthest(x, ids, center)]
    right = x[dense.farthest(x, ids, left)]
    if not dense.squared_distances(right[None, :], left)[0] > 0:
        return None
    before = None
    for step in range(steps + 1):
        side = dense.sides(x, left, right)
        if side.all() or not side.any():
            return None
        if step == steps or (before is not None and (side == before).all()):
            return left, right, side
        left, right, before = x[side == 0].mean(axis=0), x[side == 1].mean(axis=0), side
