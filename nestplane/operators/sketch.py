"""Frequent-directions sketches of the points of each dataset, for one pass over data that keeps arriving.

A sketch ``B`` of ``k`` rows stands for the rows ``A`` it has seen.  When a block of rows is stacked below it, the square of
the ``k+1``-st singular value is taken off all squares, which leaves ``k`` rows (Ghashami, Liberty, Phillips and Woodruff,
2016).  What was taken off in all, ``shrunk``, bounds the error: for every unit vector ``v``,
``0 <= |A v|^2 - |B v|^2 <= shrunk <= (|A|^2 - |B|^2) / (k + 1)`` in Frobenius norms.  Nothing is lost while ``k`` reaches the rank.

Rows are dealt to blocks by a hash of their id, taken in the order of ids, and blocks are merged in a fixed tree.  So the
answer does not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..sources.shared import Workspace
from .passes import KEYS, Fields, Front, Limits, RitzFold, batch_of, by_dataset, ddl, matrix, node_pass, node_totals, pin, records, segments

SKETCH_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("block", "bigint"),
    ("n", "bigint"),
    ("dims", "int"),
    ("squares", "double"),
    ("shrunk", "double"),
    ("rows", "array<double>"),
)
BLOCK_ROWS = 1 << 16  # points of a block, about
MERGED = 16  # sketches merged by one task of a round


class Sketch:
    """One sketch being made: rows wait until ``chunk`` of them are folded in together."""

    def __init__(self, k: int, dims: int):
        self.k, self.chunk = k, max(4 * k, 256)
        self.n, self.squares, self.shrunk = 0, 0.0, 0.0
        self.rows, self.waiting, self.size = np.zeros((0, dims)), [], 0

    def add(self, x: np.ndarray) -> None:
        """Points, in their order; where a batch ends does not matter."""
        self.n += len(x)
        while len(x):
            part, x = x[: self.chunk - self.size], x[self.chunk - self.size :]
            self.waiting.append(part)
            self.size += len(part)
            if self.size == self.chunk:
                self.fold()

    def fold(self) -> None:
        if self.waiting:
            block = np.concatenate(self.waiting)
            self.squares += float(np.einsum("ij,ij->", block, block))
            self.waiting, self.size = [], 0
            self._shrink(block)

    def merge(self, n: int, squares: float, shrunk: float, rows: np.ndarray) -> None:
        self.n, self.squares, self.shrunk = self.n + n, self.squares + squares, self.shrunk + shrunk
        self._shrink(rows)

    def _shrink(self, block: np.ndarray) -> None:
        _, s, vt = np.linalg.svd(np.vstack([self.rows, block]), full_matrices=False)
        off = s[self.k] ** 2 if len(s) > self.k else 0.0
        kept = np.sqrt(np.maximum(s[: self.k] ** 2 - off, 0.0))
        some = kept > 0
        self.shrunk += off
        self.rows = kept[some, None] * vt[: self.k][some]

    def row(self, name: str, block: int) -> tuple:
        self.fold()
        return name, block, self.n, self.rows.shape[1], self.squares, self.shrunk, self.rows.ravel()


def sketch_partitions(points: DataFrame, k: int, limits: Limits = Limits(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One sketch per dataset and block; a dataset of ``n`` points has ``ceil(n / block_rows)`` of them."""
    sizes = points.groupBy("dataset_id").agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))
    sizes = Workspace(points.sparkSession, "sketch").write(sizes, "sizes")
    large = sizes.where("_blocks > 1")  # at most the points / block_rows
    named = points.select("dataset_id", "point_id", "x").join(F.broadcast(large) if large.count() < 500_000 else large, "dataset_id", "left")
    block = F.pmod(F.xxhash64("point_id"), F.coalesce("_blocks", F.lit(1)))
    dealt = named.withColumn("block", block).drop("_blocks").repartition("dataset_id", "block").sortWithinPartitions("dataset_id", "block", "point_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            done = []
            for name, part in by_dataset(batch):
                for block, rows in segments(part.column("block").to_numpy()):
                    x = matrix(part.column("x"))[rows]
                    if (name, block) != at:
                        done += [held.row(*at)] if held else []
                        at, held = (name, block), Sketch(k, x.shape[1])
                    held.add(x)
            if done:
                yield batch_of(done, SKETCH_FIELDS)
        if held:
            yield batch_of([held.row(*at)], SKETCH_FIELDS)

    return dealt.mapInArrow(run, ddl(SKETCH_FIELDS))


def merge_sketches(sketches: DataFrame, k: int, limits: Limits = Limits(), salts: int = MERGED) -> DataFrame:
    """One sketch per dataset.  Each round merges ``salts`` (two at least) neighbouring blocks a task, in their order."""
    at_once = max(2, salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            done = []
            for key, rows in groupby(records(batch), key=lambda r: (r["dataset_id"], r["into"])):
                for r in rows:
                    if key != at:
                        done += [held.row(*at)] if held else []
                        at, held = key, Sketch(k, r["dims"])
                    held.merge(r["n"], r["squares"], r["shrunk"], np.asarray(r["rows"]).reshape(-1, r["dims"]))
            if done:
                yield batch_of(done, SKETCH_FIELDS)
        if held:
            yield batch_of([held.row(*at)], SKETCH_FIELDS)

    last = sketches.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    while True:
        last //= at_once
        into = F.expr(f"block div {at_once}") if last else F.lit(0).cast("bigint")
        dealt = sketches.withColumn("into", into).repartition("dataset_id", "into").sortWithinPartitions("dataset_id", "into", "block")
        sketches = dealt.mapInArrow(run, ddl(SKETCH_FIELDS))
        if not last:
            return sketches


def sketch(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One sketch of at most ``k`` rows per dataset, ``SKETCH_FIELDS``."""
    blocks = Workspace(points.sparkSession, "sketch").write(sketch_partitions(points, k, block_rows=block_rows), "blocks")
    return merge_sketches(blocks, k)


def svd_sketch(points: DataFrame, k: int, oversample: int = 10, limits: Limits = Limits()) -> DataFrame:
    """Incremental SVD: the ``k`` leading ``(dataset_id, component, singular_value, v)`` of each dataset's rows.

    A sketch of ``k + oversample`` rows finds the space; one more pass measures the points along it, so the singular values are those of
    the points within that space and never above the true ones.
    """
    work = Workspace(points.sparkSession, "ritz")
    found = work.write(sketch(points, k + oversample), "sketch")
    probes: Fields = (("dataset_id", "string"), ("node_id", "bigint"), ("probe", "array<double>"))
    fields: Fields = (("dataset_id", "string"), ("component", "int"), ("singular_value", "double"), ("v", "array<double>"))

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(r["dataset_id"], 0, _directions(r).ravel()) for r in records(batch)], probes)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in records(batch):
                m = int(np.sqrt(len(r["total"])))
                core, rows = np.asarray(r["total"]).reshape(m, m), np.asarray(r["probe"]).reshape(m, -1)
                w, u = np.linalg.eigh((core + core.T) / 2)
                s, v = dense.top_components(np.sqrt(np.maximum(w, 0.0)), u.T @ rows, k, dense.DIRECT_TOL)
                out.extend((r["dataset_id"], i + 1, float(s[i]), v[i]) for i in range(len(s)))
            yield batch_of(out, fields)

    nbytes = found.agg(F.coalesce(F.sum(8 * F.size("rows")), F.lit(0))).first()[0]
    probe = pin(found.mapInArrow(directions, ddl(probes)), probes, nbytes, limits, work, "probes")
    totals = node_totals(node_pass(Front(points, limits, work), RitzFold(), probe))
    return totals.select(*KEYS, "total").join(probe.df, KEYS).mapInArrow(solved, ddl(fields))


def _directions(r: dict) -> np.ndarray:
    """Orthonormal rows of a stored sketch."""
    rows = np.asarray(r["rows"]).reshape(-1, r["dims"])
    s = np.linalg.norm(rows, axis=1)
    return rows[s > 0] / s[s > 0][:, None]


def sketch_components(sketches: DataFrame, k: int) -> DataFrame:
    fields: Fields = (("dataset_id", "string"), ("component", "int"), ("singular_value", "double"), ("v", "array<double>"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in records(batch):
                rows = np.asarray(r["rows"]).reshape(-1, r["dims"])
                s = np.linalg.norm(rows, axis=1)
                s, v = dense.top_components(s, rows / np.where(s > 0, s, 1.0)[:, None], k, dense.DIRECT_TOL)
                out.extend((r["dataset_id"], i + 1, float(s[i]), v[i]) for i in range(len(s)))
            yield batch_of(out, fields)

    return sketches.mapInArrow(split, ddl(fields))


def sketch_energy(sketches: DataFrame) -> DataFrame:
    """``(dataset_id, dim, energy, shrunk, slack)``: the sketch's part of each column's sum of squares, what bounds its error,
    and ``|A|^2 - |B|^2``, of which ``shrunk`` is at most a ``k + 1``-st."""
    fields: Fields = (("dataset_id", "string"), ("dim", "int"), ("energy", "double"), ("shrunk", "double"), ("slack", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in records(batch):
                own = (np.asarray(r["rows"]).reshape(-1, r["dims"]) ** 2).sum(axis=0)
                out.extend((r["dataset_id"], i + 1, float(e), r["shrunk"], r["squares"] - float(own.sum())) for i, e in enumerate(own))
            yield batch_of(out, fields)

    return sketches.mapInArrow(run, ddl(fields))
