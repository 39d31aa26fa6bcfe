"""One pass over the points, folding the points of every node against that node's parameters.

The points are never shuffled here.  Each task takes the node of a point from the level table (or the root),
steps on by the separating centers chosen since, adds the point to a per-node accumulator, and emits one partial per
node; partials are what gets shuffled.  A root that holds every row therefore still costs each task
one small accumulator.

A level table holds the points of the nodes that are still split, and nothing else.  It is written once a level by
a narrow pass, one folder per part; a part holds the points of neighbouring nodes, or of one large node.  The
directory of parts says which of them a pass over some nodes has to read.

Node parameters reach the tasks by broadcast while their size, known from node count and dimension,
is under ``Limits.broadcast_bytes``.  Above it they are joined with the located points on the node key instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dense
from ..sources.shared import Workspace

KEYS = ["dataset_id", "node_id"]
BLOCK = 128  # doubles per shuffled row of a partial sum
FILTER_DATASETS = 500  # up to this many datasets a pass names the ones it needs, beyond it it joins them; either way the scan can prune
SALTS = 32  # parts of a node's points when they are joined with parameters too large to broadcast
JOINED_PARTS = 64  # parts of a level table whose nodes are too many to list on the driver

_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()),
    "array<array<double>>": pa.list_(pa.list_(pa.float64())),
}

Fields = tuple[tuple[str, str], ...]


def ddl(fields: Fields) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def arrow_schema(fields: Fields) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in fields])


def batch_of(rows: list[tuple], fields: Fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=_ARROW[t]) for c, (_, t) in zip(columns, fields)],
        schema=arrow_schema(fields),
    )


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between two exact ways of doing the same thing."""

    broadcast_bytes: int = 64 << 20  # node parameters sent to every task
    task_bytes: int = 256 << 20  # accumulators of one task before they are emitted
    local_rows: int = 20_000  # a node up to this size is finished in one task
    local_bytes: int = 128 << 20  # ... and up to this many bytes of coordinates
    part_bytes: int = 256 << 20  # coordinates of one part of a level table (a larger node is a part of its own)


class NodeTable:
    """A table with one row per node, computed once.

    Small ones are ``held`` by the driver, ready to broadcast; the others are written tables.  Row-wise
    changes are given as functions of an Arrow batch, so they read the same either way.
    """

    def __init__(self, spark: SparkSession, fields: Fields, held: pa.Table | None = None, written: DataFrame | None = None):
        self.spark, self.fields, self.held, self._df = spark, fields, held, written

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            rows = self.held if self.held.num_rows else []
            self._df = self.spark.createDataFrame(rows, schema=ddl(self.fields))
        return self._df

    def count(self) -> int:
        return self.held.num_rows if self.held is not None else self.df.count()

    def map(self, change, fields: Fields) -> NodeTable:
        """Rows ``change(record)`` yields for each row, a dict."""

        def changed(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch_of([out for row in records(batch) for out in change(row)], fields)

        if self.held is not None:
            done = [changed(b) for b in self.held.to_batches()]
            return NodeTable(self.spark, fields, pa.Table.from_batches(done, schema=arrow_schema(fields)))
        return NodeTable(self.spark, fields, written=self.df.mapInArrow(lambda it: map(changed, it), ddl(fields)))

    def groups(self, rows: int) -> Iterator[NodeTable]:
        """Held pieces of about ``rows`` rows, neighbours by dataset together where the order is known."""
        if self.held is not None:
            table = self.held.sort_by([(k, "ascending") for k in KEYS])
            for at in range(0, max(table.num_rows, 1), rows):
                yield NodeTable(self.spark, self.fields, table.slice(at, rows))
        else:
            parts = -(-self.count() // rows)
            for g in range(parts):
                yield hold(self.df.where(F.pmod(F.xxhash64(*KEYS), F.lit(parts)) == g), self.fields)

    def where(self, keep) -> NodeTable:
        return self.map(lambda row: [tuple(row.values())] if keep(row) else [], self.fields)


def hold(df: DataFrame, fields: Fields) -> NodeTable:
    table = df.select(*[n for n, _ in fields]).toArrow()
    return NodeTable(df.sparkSession, fields, table.cast(arrow_schema(fields)))


def pin(df: DataFrame, fields: Fields, nbytes: int, limits: Limits, work: Workspace, name: str) -> NodeTable:
    """Compute a node table once: held if ``nbytes`` allows, else written to the shared folder."""
    if nbytes <= limits.broadcast_bytes:
        return hold(df, fields)
    return NodeTable(df.sparkSession, fields, written=work.write(df.select(*[n for n, _ in fields]), name))


def records(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, with number lists as views of the column's memory."""
    columns = []
    for column in batch.columns:
        if pa.types.is_list(column.type) and column.type.value_type == pa.float64():
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            columns.append(np.split(flat, ends[:-1]) if len(ends) else [])
        else:
            columns.append(column.to_pylist())
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*columns))


def table_records(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        yield from records(batch)


def arrays_by_node(table: pa.Table, columns: Iterable[str]) -> dict[str, dict[int, tuple]]:
    out: dict[str, dict[int, tuple]] = {}
    for row in table_records(table):
        out.setdefault(row["dataset_id"], {})[row["node_id"]] = tuple(row[c] for c in columns)
    return out


# --- decoding ---------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as an (n, D) array."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if lengths.size > 1 or column.null_count:
        raise ValueError(f"points of one dataset differ in dimension: {lengths[:5].tolist()}")
    width = int(lengths[0]) if lengths.size else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def segments(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(code, row numbers)`` for each distinct code."""
    if codes.size == 0:
        return
    if (codes == codes[0]).all():
        yield int(codes[0]), np.arange(codes.size)
        return
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    for rows in np.split(order, cuts):
        yield int(codes[rows[0]]), rows


def by_dataset(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    encoded = batch.column("dataset_id").dictionary_encode()
    for code, rows in segments(encoded.indices.to_numpy()):
        yield encoded.dictionary[code].as_py(), batch if rows.size == batch.num_rows else batch.take(pa.array(rows))


def walk(x: np.ndarray, splits: dict[int, tuple], start: np.ndarray | None = None) -> np.ndarray:
    """Heap id reached from ``start`` (the root) by always stepping to the nearer of two centers."""
    node = np.zeros(len(x), dtype=np.int64) if start is None else start.copy()
    moving = np.arange(len(x)) if splits else np.zeros(0, dtype=np.int64)
    while moving.size:
        moved = []
        for j, at in segments(node[moving]):
            if j in splits:
                rows = moving[at]
                node[rows] = 2 * j + 1 + dense.sides(x[rows], *splits[j])
                moved.append(rows)
        moving = np.concatenate(moved) if moved else np.zeros(0, dtype=np.int64)
    return node


# --- where the points currently are ------------------------------------------------------------


LOCATED_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("point_id", "bigint"),
    ("x", "array<double>"),
)


ASIDE = -1  # the part of nodes that wait for the local finish
PART_FIELDS: Fields = LOCATED_FIELDS + (("part", "int"),)


@dataclass(frozen=True)
class Front:
    """Points together with what is needed to tell the node each of them is in."""

    points: DataFrame  # dataset_id, point_id, x; node_id too once ``placed``, part in a level table
    limits: Limits
    work: Workspace
    splits: dict[str, dict[int, tuple]] = field(default_factory=dict)
    split_bytes: int = 0
    placed: bool = False
    sent: list = field(default_factory=list)
    directory: dict[tuple[str, int], int] | None = None  # part of every node of a level table
    tasks: int = 0  # of a pass, about; 0: not known

    def tree(self) -> Broadcast:
        """The separating centers, broadcast once however many passes read them."""
        if not self.sent:
            self.sent.append(self.points.sparkSession.sparkContext.broadcast(self.splits))
        return self.sent[0]

    def gathers(self, nbytes: int) -> bool:
        """Whether the driver may take the partials of all tasks, ``nbytes`` at most from each, without a shuffle."""
        return 0 < self.tasks * nbytes <= self.limits.broadcast_bytes

    def release(self) -> None:
        for b in self.sent:
            b.destroy()
        self.sent.clear()

    def of_nodes(self, nodes: dict[str, dict[int, tuple]]) -> DataFrame:
        """The points, without parts (or datasets) that hold none of ``nodes``."""
        points = self.points
        if self.directory is not None:
            wanted = {self.part_of(d, j) for d, own in nodes.items() for j in own}
            if not wanted >= set(self.directory.values()):
                points = points.where(F.col("part").isin(sorted(wanted - {None})))
        if len(nodes) <= FILTER_DATASETS:
            return points.where(F.col("dataset_id").isin(list(nodes)))
        named = points.sparkSession.createDataFrame([(d,) for d in nodes], "dataset_id string")
        return points.join(F.broadcast(named), "dataset_id", "left_semi")  # fewer rows than the held parameters

    def part_of(self, name: str, node: int) -> int | None:
        """Part of the node of the level table that ``node`` is, or descends from."""
        while (name, node) not in self.directory:
            if node == 0:
                return None
            node = (node - 1) // 2
        return self.directory[name, node]

    def located(self) -> DataFrame:
        columns = ["dataset_id", "node_id", "point_id", "x"]
        if self.placed and not self.splits:
            return self.points.select(*columns)
        base = self.points.select("dataset_id", "point_id", "x", *["node_id"] * self.placed)
        if not self.splits:
            return base.withColumn("node_id", F.lit(0).cast("bigint")).select(*columns)
        known, schema, start = self.tree(), arrow_schema(LOCATED_FIELDS), start_of(self.placed)

        def locate(batches):
            for batch in batches:
                for name, part in by_dataset(batch):
                    node = walk(matrix(part.column("x")), known.value.get(name, {}), start(part))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dataset_id"), pa.array(node), part.column("point_id"), part.column("x")],
                        schema=schema,
                    )

        return base.mapInArrow(locate, ddl(LOCATED_FIELDS))

    def extend(self, pairs: NodeTable, name: str) -> Front:
        """Move the points of freshly split nodes to the nearer child."""
        if pairs.held is not None:
            grown = self.split_bytes + pairs.held.nbytes
            if grown <= self.limits.broadcast_bytes:
                merged = {d: dict(m) for d, m in self.splits.items()}
                for d, m in arrays_by_node(pairs.held, ("left", "right")).items():
                    merged.setdefault(d, {}).update(m)
                return replace(self, splits=merged, split_bytes=grown, sent=[])
        moved = move_joined(self.located(), pairs.df)
        written = self.work.write(moved, name)
        if self.placed:
            self.work.drop(self.points, keep_part=ASIDE)  # superseded by the table just written
        return replace(self, points=written, splits={}, split_bytes=0, placed=True, sent=[], directory=None)

    def settle(self, live: NodeTable, aside: NodeTable, dims: int, name: str) -> tuple[Front, DataFrame | None]:
        """The level table of the ``live`` nodes, and the points of the nodes set ``aside`` (None: there are none).

        Every other point, of a leaf or of a node that was finished, is left behind. The tables of nodes have ``n``.
        """
        columns = [n for n, _ in PART_FIELDS]
        directory = None
        if live.held is not None and aside.held is not None:
            directory = pack(live.held, dims, self.limits.part_bytes)
            put: dict[str, dict[int, int]] = {}
            for (d, j), part in directory.items():
                put.setdefault(d, {})[j] = part
            for row in table_records(aside.held):
                put.setdefault(row["dataset_id"], {})[row["node_id"]] = ASIDE
            df = self.dealt(put).select(*columns)
        else:
            parts = F.pmod(F.xxhash64(*KEYS), F.lit(JOINED_PARTS)).cast("int")
            nodes = live.df.select(*KEYS, parts.alias("part")).unionByName(aside.df.select(*KEYS, F.lit(ASIDE).alias("part")))
            df = spread_join(self.located(), nodes, KEYS).select(*columns)
        table = self.work.write(df, name, by="part")
        self.release()
        if self.placed:
            self.work.drop(self.points, keep_part=ASIDE)
        front = replace(
            self, points=table.where(F.col("part") != ASIDE), splits={}, split_bytes=0, placed=True, sent=[], directory=directory,
            tasks=self.tasks + len(set(directory.values())) if directory is not None and self.tasks else 0,
        )
        self.work.follow(front.points, table)
        return front, table.where(F.col("part") == ASIDE) if aside.count() else None

    def dealt(self, put: dict[str, dict[int, int]]) -> DataFrame:
        """The points of the nodes in ``put``, with their node and its part, by one narrow pass."""
        context, schema, start = self.points.sparkSession.sparkContext, arrow_schema(PART_FIELDS), start_of(self.placed)
        known, tree = context.broadcast(put), self.tree()

        def deal(batches):
            for batch in batches:
                for name, part in by_dataset(batch):
                    here = known.value.get(name)
                    if not here:
                        continue
                    node = walk(matrix(part.column("x")), tree.value.get(name, {}), start(part))
                    for j, rows in segments(node):
                        if j in here:
                            at = pa.array(rows)
                            fixed = [pa.array(np.full(len(rows), j)), part.column("point_id").take(at), part.column("x").take(at), pa.array(np.full(len(rows), here[j], np.int32))]
                            yield pa.RecordBatch.from_arrays([part.column("dataset_id").take(at), *fixed], schema=schema)

        nodes = {d: dict.fromkeys(own, ()) for d, own in put.items()}
        base = self.of_nodes(nodes).select("dataset_id", "point_id", "x", *["node_id"] * self.placed)
        return base.mapInArrow(deal, ddl(PART_FIELDS))


def start_of(placed: bool):
    return lambda part: part.column("node_id").to_numpy() if placed else None


def pack(nodes: pa.Table, dims: int, part_bytes: int) -> dict[tuple[str, int], int]:
    """Part of every node: neighbours by dataset and id together, up to ``part_bytes`` of coordinates."""
    out, part, held = {}, 0, 0
    for row in table_records(nodes.sort_by([(k, "ascending") for k in KEYS])):
        size = row["n"] * dims * 8
        if held and held + size > part_bytes:
            part, held = part + 1, 0
        out[row["dataset_id"], row["node_id"]] = part
        held += size
    return out


def move_joined(located: DataFrame, pairs: DataFrame) -> DataFrame:
    """Move points of split nodes to the nearer child by joining the pairs on the node key; others stay where they are."""
    joined = spread_join(located, pairs.select(*KEYS, "left", "right"), KEYS, "left")
    schema = arrow_schema(LOCATED_FIELDS)

    def run(batches):
        for batch in batches:
            for _, part in by_dataset(batch):
                for node, rows in segments(part.column("node_id").to_numpy()):
                    chunk = part.take(pa.array(rows))
                    left, right = chunk.column("left")[0].as_py(), chunk.column("right")[0].as_py()
                    if left is None:
                        place = chunk.column("node_id")
                    else:
                        side = dense.sides(matrix(chunk.column("x")), np.asarray(left), np.asarray(right))
                        place = pa.array(2 * node + 1 + side)
                    yield pa.RecordBatch.from_arrays(
                        [chunk.column("dataset_id"), place, chunk.column("point_id"), chunk.column("x")], schema=schema
                    )

    return joined.mapInArrow(run, ddl(LOCATED_FIELDS))


def spread_join(points: DataFrame, nodes: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join points with one row per node, each node's points dealt over ``SALTS`` parts so that none is one task's."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    dealt = points.withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(nodes.select("*", salts), [*keys, "_salt"], how).drop("_salt")


def attach(points: DataFrame, nodes: DataFrame, keys: list[str], how: str = "inner", limits: Limits = Limits()) -> DataFrame:
    """Points with the columns of their node: a narrow join while the nodes' measured bytes allow a broadcast."""
    stored = Workspace(points.sparkSession, "attach").write(nodes, "nodes")
    lists = [f.name for f in stored.schema if f.dataType.typeName() == "array"]
    width = F.lit(96) + sum((8 * F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))
    if (stored.agg(F.sum(width)).first()[0] or 0) <= limits.broadcast_bytes:
        return points.join(F.broadcast(stored), keys, how)
    return spread_join(points, stored, keys, how)


# --- folds -------------------------------------------------------------------------------------


class Accumulators:
    """Per-node accumulators of one task, emitted when they outgrow ``task_bytes`` and at the end."""

    def __init__(self, fold, task_bytes: int):
        self.fold, self.task_bytes, self.state, self.size = fold, task_bytes, {}, 0

    def add(self, key: tuple[str, int], x: np.ndarray, ids: np.ndarray, params: tuple) -> None:
        before = self.state.get(key)
        after = self.fold.add(before, x, ids, params)
        if before is None:
            self.size += self.fold.size(after)
        self.state[key] = after

    def drain(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.state or not (force or self.size > self.task_bytes):
            return
        rows: list[tuple] = []
        for (name, node), acc in self.state.items():
            rows.extend((name, node, *r) for r in self.fold.emit(acc))
            if len(rows) >= 4096:
                yield batch_of(rows, self.fold.fields)
                rows = []
        if rows:
            yield batch_of(rows, self.fold.fields)
        self.state, self.size = {}, 0


def node_pass(front: Front, fold, params: NodeTable | None = None) -> DataFrame:
    """Partials of ``fold`` for every node in ``params`` (without it: for every node the points are in)."""
    columns, task_bytes, placed = fold.params, front.limits.task_bytes, front.placed
    held = params is not None and params.held is not None
    attached = params is not None and not held
    wanted = ["dataset_id", "point_id", "x", *["node_id"] * placed]
    known, tree = None, None
    if attached:
        points = spread_join(front.located(), params.df.select(*KEYS, *columns), KEYS)
    else:
        context = front.points.sparkSession.sparkContext
        nodes = arrays_by_node(params.held, columns) if held else None
        points = (front.of_nodes(nodes) if held else front.points).select(*wanted)
        known = context.broadcast(nodes) if held else None
        tree = front.tree() if front.splits or not placed else None
    start = start_of(placed)

    def run(batches):
        acc = Accumulators(fold, task_bytes)
        for batch in batches:
            for name, part in by_dataset(batch):
                here = known.value.get(name) if known is not None else None
                if known is not None and not here:
                    continue
                x, ids = matrix(part.column("x")), part.column("point_id").to_numpy()
                place = walk(x, tree.value.get(name, {}), start(part)) if tree is not None else part.column("node_id").to_numpy()
                for node, rows in segments(place):
                    if attached:
                        given = tuple(as_parameter(part.column(c)[int(rows[0])].as_py()) for c in columns)
                    elif here is None or node in here:
                        given = here[node] if here else ()
                    else:
                        continue
                    whole = rows.size == len(x)
                    acc.add((name, node), x if whole else x[rows], ids if whole else ids[rows], given)
                    yield from acc.drain()
        yield from acc.drain(force=True)

    return points.mapInArrow(run, ddl(fold.fields))


def as_parameter(value):
    return np.asarray(value, dtype=np.float64) if isinstance(value, list) else value


SUM_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("block", "int"),
    ("n", "bigint"),
    ("mark", "bigint"),
    ("v", "array<double>"),
)


def blocks(n: int, mark: int, v: np.ndarray) -> Iterator[tuple]:
    for b, start in enumerate(range(0, len(v), BLOCK)):
        yield b, n if b == 0 else 0, mark if b == 0 else 0, v[start : start + BLOCK]


class SumFold:
    """Row count and vector sum of each node."""

    params: tuple[str, ...] = ()
    fields = SUM_FIELDS

    def add(self, acc, x, ids, params):
        n, total = (0, 0.0) if acc is None else acc
        return n + len(x), total + x.sum(axis=0)

    def size(self, acc):
        return acc[1].nbytes + 64

    def emit(self, acc):
        yield from blocks(acc[0], 0, acc[1])


class SideFold:
    """Both sides of each node's pair of centers: vector sums, sizes, and a fingerprint of the left ids.

    The sum is one vector: left, right, then the two sizes (whole numbers, exact as doubles).
    """

    params = ("left", "right")
    fields = SUM_FIELDS

    def add(self, acc, x, ids, params):
        n, mark, v = (0, 0, 0.0) if acc is None else acc
        side = dense.sides(x, *params)
        member = np.stack([1.0 - side, side])
        total = np.concatenate([(member @ x).ravel(), member.sum(axis=1)])
        return n + len(x), mark ^ dense.mark(ids[side == 0]), v + total

    def size(self, acc):
        return acc[2].nbytes + 64

    def emit(self, acc):
        yield from blocks(*acc)


FAR_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("d2", "double"),
    ("point_id", "bigint"),
    ("x", "array<double>"),
)


class FarFold:
    """The point of each node farthest from ``center``, smallest id among equals: one row a node and task."""

    params = ("center",)
    fields = FAR_FIELDS

    def add(self, acc, x, ids, params):
        at = dense.farthest(x, ids, params[0])
        d2 = float(dense.comparable(dense.squared_distances(x[at : at + 1], params[0]))[0])
        found = (d2, int(ids[at]), x[at].copy())
        return found if acc is None or (found[0], -found[1]) > (acc[0], -acc[1]) else acc

    def size(self, acc):
        return 96 + acc[2].nbytes

    def emit(self, acc):
        yield acc


SCATTER_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("slot", "int"),
    ("row", "bigint"),
    ("block", "int"),
    ("n", "bigint"),
    ("v", "array<double>"),
)
SLOT_ROWS = 4  # rows, in widths, that a task of the combining step gets


class ScatterFold:
    """What a node's scatter matrix about ``center`` is made of, in the smaller of two forms.

    While a task has met fewer than D/2 points of a node, it keeps their centered rows; then it folds them into the upper triangle
    of the scatter matrix, which is no larger.  ``slot`` -1 marks blocks of the triangle; rows, cut into blocks as well, have their
    point's id as ``row`` and a slot in which they can meet others of the node.
    """

    params = ("center", "n")
    fields = SCATTER_FIELDS

    def add(self, acc, x, ids, params):
        c = x - params[0]
        n, rows, own, s, size = (0, [], [], None, int(params[1])) if acc is None else acc
        rows, own = [*rows, c], [*own, ids]
        if s is not None or 2 * sum(map(len, rows)) >= x.shape[1]:
            c = np.concatenate(rows)
            s, rows, own = (0.0 if s is None else s) + c.T @ c, [], []
        return n + len(x), rows, own, s, size

    def size(self, acc):
        return acc[3].nbytes if acc[3] is not None else 4 * acc[1][0].shape[1] ** 2

    def emit(self, acc):
        n, rows, own, s, size = acc
        if s is not None:
            for b, n, _, v in blocks(n, 0, dense.pack(s)):
                yield -1, 0, b, n, v
            return
        slots = max(1, size // (SLOT_ROWS * rows[0].shape[1]))
        for i, line in zip(np.concatenate(own).tolist(), np.concatenate(rows)):
            for b, n, _, v in blocks(1, 0, line):
                yield i % slots, i, b, n, v


QR_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("slot", "int"),
    ("row", "int"),
    ("n", "bigint"),
    ("v", "array<double>"),
)


class QrFold:
    """The triangular factor of each node's points about ``center``, one row of it a row; ``slot`` is the task."""

    params = ("center",)
    fields = QR_FIELDS

    def add(self, acc, x, ids, params):
        return self.fold(acc, x - params[0], len(x))

    def fold(self, acc, c: np.ndarray, n: int):
        """Keep rows until they are twice as many as columns, then factor them together with what was factored."""
        seen, held, size = (0, [], 0) if acc is None else acc
        held, size = [*held, c], size + len(c)
        if size >= 2 * c.shape[1]:
            held = [np.linalg.qr(np.concatenate(held), mode="r")]
            size = len(held[0])
        return seen + n, held, size

    def size(self, acc):
        return 16 * acc[1][0].shape[1] ** 2

    def emit(self, acc):
        n, held, size = acc
        r = np.concatenate(held)
        r = np.linalg.qr(r, mode="r") if len(r) > r.shape[1] else r
        task = TaskContext.get().partitionId()
        yield from ((task, i, n if i == 0 else 0, line) for i, line in enumerate(r))


class ProbeFold:
    """Scatter matrix about ``center`` times a thin probe matrix, never forming the D x D product."""

    params = ("center", "probe")
    fields = SUM_FIELDS

    def add(self, acc, x, ids, params):
        center, probe = params
        c = x - center
        q = probe.reshape(x.shape[1], -1)
        n, y = (0, 0.0) if acc is None else acc
        return n + len(x), y + c.T @ (c @ q)

    def size(self, acc):
        return acc[1].nbytes

    def emit(self, acc):
        yield from blocks(acc[0], 0, acc[1].ravel())


class RitzFold:
    """Inner products of the points' coordinates along the orthonormal rows of ``probe``."""

    params = ("probe",)
    fields = SUM_FIELDS

    def add(self, acc, x, ids, params):
        y = x @ params[0].reshape(-1, x.shape[1]).T
        n, s = (0, 0.0) if acc is None else acc
        return n + len(x), s + y.T @ y

    def size(self, acc):
        return acc[1].nbytes

    def emit(self, acc):
        yield from blocks(acc[0], 0, acc[1].ravel())


TOTAL_FIELDS: Fields = (
    ("dataset_id", "string"),
    ("node_id", "bigint"),
    ("n", "bigint"),
    ("mark", "bigint"),
    ("total", "array<double>"),
)


def sum_partials(partials: DataFrame) -> DataFrame:
    """Add partial blocks by key; a row is at most ``BLOCK`` doubles, so wide sums spread over reducers."""
    return partials.groupBy(*KEYS, "block").agg(
        F.sum("n").alias("n"),
        F.bit_xor("mark").alias("mark"),
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"),
    )


def node_totals(partials: DataFrame) -> DataFrame:
    """Added partials with the blocks of a node put together, one row per node."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "v")))
    return (
        sum_partials(partials)
        .groupBy(*KEYS)
        .agg(
            F.sum("n").alias("n"),
            F.bit_xor("mark").alias("mark"),
            F.flatten(F.transform(ordered, lambda b: b["v"])).alias("total"),
        )
    )


def pin_totals(partials: DataFrame, nbytes: int, front: Front, name: str) -> NodeTable:
    """``node_totals`` as a node table.

    When it is held anyway, the blocks are put together on arrival; small partials are even added there, in the order of tasks.
    """
    spark = partials.sparkSession
    if nbytes > front.limits.broadcast_bytes:
        return NodeTable(spark, TOTAL_FIELDS, written=front.work.write(node_totals(partials), name))
    found: dict[tuple, dict[int, list]] = {}
    for row in table_records((partials if front.gathers(nbytes) else sum_partials(partials)).toArrow()):
        own = found.setdefault((row["dataset_id"], row["node_id"]), {})
        held = own.setdefault(row["block"], [0, 0, 0.0])
        own[row["block"]] = [held[0] + row["n"], held[1] ^ row["mark"], held[2] + row["v"]]
    rows = [(*key, own[0][0], own[0][1], np.concatenate([own[b][2] for b in sorted(own)])) for key, own in found.items()]
    return NodeTable(spark, TOTAL_FIELDS, pa.Table.from_batches([batch_of(rows, TOTAL_FIELDS)]))


def farthest_of(partials: DataFrame) -> DataFrame:
    """Best candidate of each node over all tasks."""
    best = F.max_by(F.struct("d2", "point_id", "x"), F.struct("d2", (-F.col("point_id")).alias("neg_id"))).alias("b")
    return partials.groupBy(*KEYS).agg(best).select(*KEYS, "b.d2", "b.point_id", "b.x")


def farthest_held(table: pa.Table) -> pa.Table:
    """The same of a few gathered candidates."""
    best: dict[tuple, dict] = {}
    for row in table_records(table):
        key = row["dataset_id"], row["node_id"]
        if key not in best or (row["d2"], -row["point_id"]) > (best[key]["d2"], -best[key]["point_id"]):
            best[key] = row
    rows = [tuple(row[n] for n, _ in FAR_FIELDS) for row in best.values()]
    return pa.Table.from_batches([batch_of(rows, FAR_FIELDS)])
