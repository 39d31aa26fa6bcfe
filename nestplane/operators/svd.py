"""Truncated SVD of many matrices at once, each the points of one node about its center.

Three ways:

- The scatter matrix is summed over partitions in blocks and diagonalised, one bounded task per node, at any
  width.  Singular values below 1e-7 of the first are lost in the squares.
- Partial QR factors of the points are merged in a tree (Demmel, Grigori, Hoemmen and Langou, 2012) and the last one is
  decomposed; nothing is squared, so values down to 1e-9 of the first are right.
- Block Krylov probes (Musco and Musco, 2015) multiply a thin matrix by the scatter matrix without forming it, until
  the residual of every wanted component is under a tolerance, or raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from .passes import (
    KEYS,
    QR_FIELDS,
    SCATTER_FIELDS,
    Fields,
    Front,
    NodeTable,
    ProbeFold,
    QrFold,
    ScatterFold,
    attach,
    batch_of,
    blocks,
    ddl,
    hold,
    node_pass,
    node_totals,
    pin,
    records,
)
from .split import level_bytes

PLANE_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("basis", "array<array<double>>"),
    ("singular_values", "array<double>"),
)
OVERSAMPLE = 10
MERGED = 16  # factors merged by one task of a round
RESIDUAL = 1e-10  # of a probed component, against the first eigenvalue


# --- scatter matrices -----------------------------------------------------------------------------


def scatter(front: Front, centers: NodeTable) -> DataFrame:
    """What the scatter matrices about the node centers are made of, ``SCATTER_FIELDS``: blocks of their packed upper
    triangles, summed, and centered rows of nodes with few points.

    Centers come with the node's ``n``. Of one node at most about ``SLOT_ROWS * D`` rows a task, and no more
    than ``task_bytes`` in all, stay rows: beyond that they meet by slots and are folded first.
    """
    partials = node_pass(front, ScatterFold(), centers)
    most, dims = largest(centers)
    rows = min(most, front.tasks * dims // 2 if front.tasks else most)
    if rows * dims * 8 > front.limits.task_bytes:
        partials = combined(partials, dims)
    return summed(partials)


def largest(centers: NodeTable) -> tuple[int, int]:
    """Points of the largest node, and the widest center."""
    if centers.held is not None:
        both = [(r["n"], len(r["center"])) for r in node_records(centers)]
        return max((b[0] for b in both), default=0), max((b[1] for b in both), default=0)
    row = centers.df.agg(F.max("n"), F.max(F.size("center"))).first()
    return row[0] or 0, row[1] or 0


def summed(partials: DataFrame) -> DataFrame:
    """Blocks of one place added up; a block of a row is alone in its place."""
    v = vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
    return partials.groupBy(*KEYS, "row", "block").agg(F.max("slot").alias("slot"), F.sum("n").alias("n"), v).select(*[n for n, _ in SCATTER_FIELDS])


def combined(partials: DataFrame, dims: int) -> DataFrame:
    """Rows of one slot met and folded into blocks where that is smaller; blocks pass."""
    key = F.when(F.col("slot") < 0, F.col("block")).otherwise(-1 - F.col("slot"))
    dealt = partials.withColumn("_key", key).repartition(*KEYS, "_key").sortWithinPartitions(*KEYS, "slot", "row", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def released() -> Iterator[tuple]:
            name, node, slot = at
            x = np.concatenate([r["v"] for r in held]).reshape(-1, dims)
            if 2 * len(x) >= dims:
                for b, n, _, v in blocks(len(x), 0, dense.pack(x.T @ x)):
                    yield name, node, -1, 0, b, n, v
            else:
                yield from ((name, node, slot, r["row"], r["block"], r["n"], r["v"]) for r in held)

        for batch in batches:
            out = []
            for row in records(batch):
                here = row["dataset_id"], row["node_id"], row["slot"]
                if held and here != at:
                    out.extend(released())
                    held = []
                at = here
                if row["slot"] < 0:
                    out.append(tuple(row[n] for n, _ in SCATTER_FIELDS))
                else:
                    held.append(row)
            if out:
                yield batch_of(out, SCATTER_FIELDS)
        if held:
            yield batch_of(list(released()), SCATTER_FIELDS)

    return dealt.select(*[n for n, _ in SCATTER_FIELDS]).mapInArrow(run, ddl(SCATTER_FIELDS))


def parts_of(table: pa.Table) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The scatter matrix and the rows among one node's parts, either possibly absent."""
    table = table.sort_by([("slot", "ascending"), ("row", "ascending"), ("block", "ascending")]).combine_chunks()
    blocks_ = int((table.column("slot").to_numpy() < 0).sum())
    values = table.column("v").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    packed, lines = values[:blocks_].flatten().to_numpy(), values[blocks_:].flatten().to_numpy()
    matrix = dense.unpack(packed) if blocks_ else None
    if blocks_ == table.num_rows:
        return matrix, None
    rows = len(np.unique(table.column("row").to_numpy()[blocks_:]))
    return matrix, lines.reshape(rows, -1)


def whole_scatter(table: pa.Table) -> np.ndarray:
    matrix, rows = parts_of(table)
    return (0.0 if matrix is None else matrix) + (0.0 if rows is None else rows.T @ rows)


def scatter_entries(parts: DataFrame) -> DataFrame:
    """``(dataset_id, node_id, i, j, value)`` with ``i <= j``, counted from 1."""
    fields: Fields = (("dataset_id", "string"), ("node_id", "bigint"), ("i", "int"), ("j", "int"), ("value", "double"))

    def opened(table: pa.Table) -> pa.Table:
        values = dense.pack(whole_scatter(table))
        i, j = np.triu_indices(int((np.sqrt(8 * values.size + 1) - 1) / 2))
        keys = [pa.array([table.column(k)[0].as_py()] * len(values), t) for k, t in zip(KEYS, (pa.string(), pa.int64()))]
        columns = [*keys, pa.array((i + 1).astype(np.int32)), pa.array((j + 1).astype(np.int32)), pa.array(values)]
        return pa.Table.from_arrays(columns, names=[n for n, _ in fields])

    return parts.groupBy(*KEYS).applyInArrow(opened, ddl(fields))


def gram_planes(front: Front, centers: NodeTable, d: int, tol: float = dense.SCATTER_TOL) -> DataFrame:
    """Top ``d`` right singular vectors of every node from its scatter matrix (from its rows, where they are few)."""

    def solve(table: pa.Table) -> pa.Table:
        matrix, rows = parts_of(table)
        if matrix is None and rows.shape[0] <= rows.shape[1]:
            s, basis = dense.plane_of_rows(rows, d, tol)
        else:
            s, basis = dense.plane_of_scatter((0.0 if matrix is None else matrix) + (0.0 if rows is None else rows.T @ rows), d, tol)
        row = (table.column("dataset_id")[0].as_py(), table.column("node_id")[0].as_py(), list(map(list, basis)), list(s))
        return pa.Table.from_batches([batch_of([row], PLANE_FIELDS)])

    return scatter(front, centers).groupBy(*KEYS).applyInArrow(solve, ddl(PLANE_FIELDS))


# --- QR factors -----------------------------------------------------------------------------------


def merged_factors(factors: DataFrame, tasks: int) -> DataFrame:
    """One triangular factor per node from ``QR_FIELDS``; each round merges the factors of ``MERGED`` neighbouring slots.

    A task folds factors one after the other, so it holds two at a time.
    """
    while tasks > 1:
        tasks = -(-tasks // MERGED)
        met = factors.withColumn("slot", F.floor(F.col("slot") / MERGED).cast("int") if tasks > 1 else F.lit(0))
        factors = met.repartition(*KEYS, "slot").sortWithinPartitions(*KEYS, "slot", "row").mapInArrow(refactored, ddl(QR_FIELDS))
    return factors


def refactored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and slot, as one factor a node and slot."""
    fold, at, acc = QrFold(), None, None

    def released() -> list[tuple]:
        return [(*at[:2], at[2], *r[1:]) for r in fold.emit(acc)]

    for batch in batches:
        out, rows = [], list(records(batch))
        for here, own in groupby(rows, key=lambda r: (r["dataset_id"], r["node_id"], r["slot"])):
            if at is not None and here != at:
                out.extend(released())
                acc = None
            at, own = here, list(own)
            acc = fold.fold(acc, np.stack([r["v"] for r in own]), sum(r["n"] for r in own))
        if out:
            yield batch_of(out, QR_FIELDS)
    if at is not None:
        yield batch_of(released(), QR_FIELDS)


def qr_planes(front: Front, centers: NodeTable, d: int, tol: float = dense.DIRECT_TOL) -> DataFrame:
    """Top ``d`` right singular vectors of every node's centered points, none of them squared."""
    factors = front.work.write(node_pass(front, QrFold(), centers), "factors")
    tasks = factors.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        r = np.array(table.column("v").to_pylist())
        s, basis = dense.plane_of_factor(r, d, tol)
        row = (table.column("dataset_id")[0].as_py(), table.column("node_id")[0].as_py(), list(map(list, basis)), list(s))
        return pa.Table.from_batches([batch_of([row], PLANE_FIELDS)])

    return merged_factors(factors, tasks).groupBy(*KEYS).applyInArrow(solve, ddl(PLANE_FIELDS))


# --- probes ---------------------------------------------------------------------------------------


class NotConverged(RuntimeError):
    """A component's residual stayed above the tolerance for all passes allowed."""


def probe_planes(
    front: Front,
    centers: NodeTable,
    d: int,
    rows: int,
    dims: int,
    tag: str,
    oversample: int = OVERSAMPLE,
    passes: int = 0,
    tol: float = dense.SCATTER_TOL,
    residual: float = RESIDUAL,
    seed: int = 50,
) -> DataFrame:
    """Top ``d`` right singular vectors by block Krylov probes, for points too wide for a scatter matrix.

    A pass multiplies each node's newest probe by its scatter matrix ``C``; the product, made orthogonal to all
    earlier probes, is the next one. Of every wanted component ``(s, v)`` of the space reached so far, ``|C v - s**2 v|`` is known without a further pass; a
    node is done when all are at most ``residual`` times the first ``s**2``. Nodes that are not done after ``passes`` (0: until the space is the
    whole one) raise ``NotConverged``. Probes are the widest node parameters, so nodes are taken in groups whose
    spaces fit a broadcast; a group's passes read its parts of the points only.
    """
    width = max(1, min(d + oversample, dims))
    most = passes or -(-dims // width) + 1
    at_once = max(1, front.limits.broadcast_bytes // level_bytes(1, dims, 2 * width * most))
    done = [of_group(front, g, d, width, most, tol, residual, seed, f"{tag}-group{i}") for i, g in enumerate(centers.groups(at_once))]
    return reduce(DataFrame.unionByName, [pin(x.df, PLANE_FIELDS, level_bytes(rows, dims, d), front.limits, front.work, f"{tag}{i}").df for i, x in enumerate(done)])


PROBE_FIELDS: Fields = (("dataset_id", "string"), ("node_id", "bigint"), ("center", "array<double>"), ("probe", "array<double>"))


class Krylov:
    """The space of one node: orthonormal probes and their products with the scatter matrix."""

    def __init__(self, center: np.ndarray, width: int, seed: int):
        self.center = np.asarray(center, dtype=np.float64)
        start = np.random.default_rng(seed).standard_normal((len(self.center), min(width, len(self.center))))
        self.new, self.q, self.z = np.linalg.qr(start)[0], np.zeros((len(self.center), 0)), np.zeros((len(self.center), 0))

    def grow(self, product: np.ndarray) -> None:
        """Take the newest probe's product, and prepare the next probe (no columns: the space is closed)."""
        self.q, self.z = np.hstack([self.q, self.new]), np.hstack([self.z, product])
        rest, size = product, np.linalg.norm(product, axis=0).max(initial=0.0)
        for _ in range(2):
            rest = rest - self.q @ (self.q.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        room = len(self.center) - self.q.shape[1]
        self.new = u[:, s > 1e-13 * max(size, 1e-300)][:, :room]
        if self.new.shape[1]:
            self.new = np.linalg.qr(self.new - self.q @ (self.q.T @ self.new))[0]

    def components(self, d: int, tol: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Singular values, vectors, and the greatest residual against the first eigenvalue."""
        core = self.q.T @ self.z
        w, u = np.linalg.eigh((core + core.T) / 2)
        w, u = w[::-1][:d], u[:, ::-1][:, :d]
        if not w.size or w[0] <= 0:
            return np.zeros(0), np.zeros((0, len(self.center))), 0.0
        wanted = w > tol * tol * w[0]
        off = np.linalg.norm(self.z @ u - (self.q @ u) * w, axis=0)[wanted].max(initial=0.0) / w[0]
        s, basis = dense.top_components(np.sqrt(np.maximum(w, 0.0)), (self.q @ u).T, d, tol)
        return s, basis, float(off)


def of_group(front: Front, centers: NodeTable, d: int, width: int, most: int, tol: float, residual: float, seed: int, name: str) -> NodeTable:
    """``probe_planes`` of a few nodes, whose spaces the driver holds."""
    spaces = {(r["dataset_id"], r["node_id"]): Krylov(r["center"], width, seed) for r in node_records(centers)}
    found: list[tuple] = []
    for step in range(1, most + 1):
        rows = [(*key, k.center, k.new.ravel()) for key, k in spaces.items()]
        probe = NodeTable(front.points.sparkSession, PROBE_FIELDS, held=pa.Table.from_batches([batch_of(rows, PROBE_FIELDS)]))
        products = hold(node_totals(node_pass(front, ProbeFold(), probe)), TOTALS)
        for r in node_records(products):
            space = spaces[r["dataset_id"], r["node_id"]]
            space.grow(np.asarray(r["total"]).reshape(len(space.center), -1))
        for key, space in list(spaces.items()):
            s, basis, off = space.components(d, tol)
            if off <= residual or not space.new.shape[1]:
                found.append((*key, list(map(list, basis)), list(s)))
                del spaces[key]
        if not spaces:
            break
    if spaces:
        key, space = next(iter(spaces.items()))
        raise NotConverged(f"{len(spaces)} nodes after {most} passes, the first {key} with a residual of {space.components(d, tol)[2]:.1e}")
    return NodeTable(front.points.sparkSession, PLANE_FIELDS, held=pa.Table.from_batches([batch_of(found, PLANE_FIELDS)]))


TOTALS: Fields = (("dataset_id", "string"), ("node_id", "bigint"), ("total", "array<double>"))


def node_records(nodes: NodeTable) -> Iterator[dict]:
    for batch in nodes.held.to_batches():
        yield from records(batch)


def planes(front: Front, centers: NodeTable, d: int) -> DataFrame:
    """``(dataset_id, node_id, basis, singular_values)`` of every node: exact, whatever the width or the number of rows.

    The scatter matrix is summed in blocks over many reducers and solved one node a task: 29 MB at 2,676
    columns. ``probe_planes`` is for points too wide for that; nothing chooses it by itself.
    """
    return gram_planes(front, centers, d)


def components(planes_df: DataFrame) -> DataFrame:
    """One row per kept component: ``(dataset_id, node_id, component, singular_value, v)``."""
    pairs = F.posexplode(F.arrays_zip("singular_values", "basis")).alias("pos", "c")
    return planes_df.select(*KEYS, pairs).select(
        *KEYS,
        (F.col("pos") + 1).cast("int").alias("component"),
        F.col("c.singular_values").alias("singular_value"),
        F.col("c.basis").alias("v"),
    )


def left_vectors(coords: DataFrame, planes_df: DataFrame) -> DataFrame:
    """Left singular vectors: centered coordinates over singular values, row by row."""
    u = F.zip_with("coord", "singular_values", lambda c, s: c / s)
    return attach(coords, planes_df.select(*KEYS, "singular_values"), KEYS).select(*KEYS, "point_id", u.alias("u"))


def first_components(planes_df: DataFrame, d: int) -> DataFrame:
    """Cut every basis to its ``d`` leading rows."""
    return planes_df.withColumn("basis", F.slice("basis", 1, d)).withColumn(
        "singular_values", F.slice("singular_values", 1, d)
    )
