"""Running count, center and scatter of arriving points.

Each micro-batch writes its own sums (``BatchState``).  Sums are taken about a fixed shift, which
keeps them accurate when points lie far from the origin, and add up across batches.  The products are kept by pairs of
column blocks; where all pairs together outgrow a task, the points are read once for every group of pairs that does not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dense
from ..operators.passes import (
    BLOCK,
    SUM_FIELDS,
    Fields,
    Front,
    Limits,
    batch_of,
    ddl,
    node_pass,
    records,
    sum_partials,
)
from ..sources.shared import Workspace
from .state import BatchState


@dataclass(frozen=True)
class MomentFold:
    """Vector sum, and the products of some pairs of column blocks, both about ``shift``.

    Block ``i * C + j`` of C column blocks holds the products of blocks ``i <= j``; the vector sum has the blocks -1 to -C.
    """

    shift: float = 0.0
    block: int = BLOCK
    group: int = 0
    groups: int = 1
    params: tuple[str, ...] = ()
    fields: Fields = SUM_FIELDS

    def pairs(self, dims: int) -> list[tuple[int, int]]:
        c = -(-dims // self.block)
        every = [(i, j) for i in range(c) for j in range(i, c)]
        return every[self.group :: self.groups]

    def cut(self, x: np.ndarray, i: int) -> np.ndarray:
        return x[..., i * self.block : (i + 1) * self.block]

    def add(self, acc, x, ids, params):
        c = x - self.shift
        n, v, s = (0, 0.0, {}) if acc is None else acc
        for i, j in self.pairs(x.shape[1]):
            s[i, j] = s.get((i, j), 0.0) + self.cut(c, i).T @ self.cut(c, j)
        return n + len(x), v + c.sum(axis=0), s

    def size(self, acc):
        return acc[1].nbytes + sum(m.nbytes for m in acc[2].values())

    def emit(self, acc):
        n, v, s = acc
        c = -(-len(v) // self.block)
        if self.group == 0:
            yield from ((-1 - i, n if i == 0 else 0, 0, self.cut(v, i)) for i in range(c))
        yield from ((i * c + j, 0, 0, m.ravel()) for (i, j), m in s.items())


def batch_moments(points: DataFrame, shift: float = 0.0, limits: Limits = Limits(), block: int = BLOCK) -> DataFrame:
    """Summed blocks ``(dataset_id, node_id, block, n, mark, v)`` of a batch, as ``MomentFold`` numbers them."""
    front = Front(points, limits, Workspace(points.sparkSession, "moments"))
    dims = points.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    c = -(-dims // block)
    groups = max(1, min(c * (c + 1) // 2, -(-c * (c + 1) // 2 * block * block * 8 // limits.task_bytes)))
    passes = [node_pass(front, MomentFold(shift, block, g, groups)) for g in range(groups)]
    return sum_partials(reduce(DataFrame.unionByName, passes))


def _state(spark: SparkSession, path: str) -> BatchState:
    return BatchState(spark, path, ddl(SUM_FIELDS))


def run_moments(
    points: DataFrame, path: str, checkpoint: str, shift: float = 0.0, limits: Limits = Limits(), block: int = BLOCK, compact_every: int = 64, **trigger
) -> StreamingQuery:
    """Keep the moments under ``path`` up to date with the stream ``points``; every ``compact_every`` batches they become one table (0: never)."""
    state = _state(points.sparkSession, path)

    def save(batch: DataFrame, batch_id: int) -> None:
        state.put(batch_moments(batch, shift, limits, block), batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            state.compact(lambda stored: sum_partials(stored.drop("batch_id")), batch_id)

    writer = points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def merged_moments(spark: SparkSession, path: str, shift: float = 0.0) -> DataFrame:
    """``(dataset_id, n, center, scatter)`` over all batches; ``scatter`` is packed by rows of its upper triangle."""
    fields: Fields = (("dataset_id", "string"), ("n", "bigint"), ("center", "array<double>"), ("scatter", "array<double>"))

    def finish(table: pa.Table) -> pa.Table:
        rows = {r["block"]: r for b in table.to_batches() for r in records(b)}
        c = sum(b < 0 for b in rows)
        n, total = rows[-1]["n"], np.concatenate([rows[-1 - i]["v"] for i in range(c)])
        at = np.cumsum([0] + [len(rows[-1 - i]["v"]) for i in range(c)])
        scatter = np.zeros((len(total), len(total)))
        for i in range(c):
            for j in range(i, c):
                scatter[at[i] : at[i + 1], at[j] : at[j + 1]] = np.asarray(rows[i * c + j]["v"]).reshape(at[i + 1] - at[i], -1)
        mean = total / n
        row = (rows[-1]["dataset_id"], n, mean + shift, dense.pack(scatter) - n * dense.pack(np.outer(mean, mean)))
        return pa.Table.from_batches([batch_of([row], fields)])

    return sum_partials(_state(spark, path).read().drop("batch_id")).groupBy("dataset_id").applyInArrow(finish, ddl(fields))


def moments_plane(moments: DataFrame, d: int) -> DataFrame:
    """Running SVD: ``(dataset_id, component, singular_value, v)`` from merged moments."""
    fields: Fields = (("dataset_id", "string"), ("component", "int"), ("singular_value", "double"), ("v", "array<double>"))

    def solve(batches):
        for batch in batches:
            out = []
            for row in records(batch):
                s, basis = dense.plane_of_scatter(dense.unpack(row["scatter"]), d)
                out.extend((row["dataset_id"], i + 1, float(s[i]), basis[i]) for i in range(len(s)))
            yield batch_of(out, fields)

    return moments.select("dataset_id", "scatter").mapInArrow(solve, ddl(fields))


def stream_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over one parquet table, whether ``path`` is a folder of part files or a single file.

    The file source takes folders and patterns only, so the path is given as a pattern that matches itself.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
