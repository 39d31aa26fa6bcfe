"""Checks, shapes, row numbers and leading rows of keyed tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dense
from ..sources.shared import Workspace

BROADCAST_ROWS = 500_000  # trajectory ids with a frame id, or ranges of ids, that may be broadcast
BATCH_IDS = 1 << 20  # ids of a bucket in which repeated ones are looked for
MERGE_PARTS = 64  # tasks that first merge the leading ids of one trajectory
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row within its partition in the low 33 bits


# --- checks -------------------------------------------------------------------------------------


def _pieces(points: DataFrame) -> DataFrame:
    """What each task sees of each dataset: counts of rows and defects, its least and greatest id, and ids it saw again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        for batch in batches:
            encoded = batch.column("dataset_id").dictionary_encode()
            codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                name = None if code < 0 else encoded.dictionary[int(code)].as_py()
                part = batch.filter(pa.array(codes == code))
                x, ids = part.column("x"), part.column("point_id")
                sizes = x.value_lengths().drop_null().to_numpy(zero_copy_only=False)
                values = x.drop_null().flatten()
                bad = values.null_count + int((~np.isfinite(values.drop_null().to_numpy(zero_copy_only=False))).sum())
                own = held.setdefault(name, [0, None, None, 0, 0, 0, []])
                own[0] += part.num_rows
                if len(sizes):
                    own[1] = int(sizes.min()) if own[1] is None else min(own[1], int(sizes.min()))
                    own[2] = int(sizes.max()) if own[2] is None else max(own[2], int(sizes.max()))
                own[3] += x.null_count
                own[4] += bad
                own[5] += ids.null_count
                own[6].append(ids.drop_null().to_numpy(zero_copy_only=False))
        for name, (n, lo, hi, nulls, bad, null_ids, ids) in held.items():
            ids = np.sort(np.concatenate(ids))
            again = int((ids[1:] == ids[:-1]).sum())
            ends = (int(ids[0]), int(ids[-1])) if len(ids) else (None, None)
            row = (name, n, lo, hi, nulls, bad, null_ids, again, *ends)
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE, row))], schema=_PIECE_SCHEMA)

    schema = "dataset_id string, n bigint, lo int, hi int, nulls bigint, bad bigint, null_ids bigint, again bigint, first bigint, last bigint"
    return points.select("dataset_id", F.col("point_id").cast("bigint").alias("point_id"), "x").mapInArrow(run, schema)


_PIECE = ("dataset_id", "n", "lo", "hi", "nulls", "bad", "null_ids", "again", "first", "last")
_PIECE_SCHEMA = pa.schema([(c, pa.string() if c == "dataset_id" else pa.int32() if c in ("lo", "hi") else pa.int64()) for c in _PIECE])


def _shared_ranges(pieces: DataFrame) -> DataFrame:
    """``(dataset_id, start, stop)``: ranges of ids that two tasks or more may hold; an id seen twice is in one of them."""
    earlier = Window.partitionBy("dataset_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("last").over(earlier)  # a row per task and dataset
    met = pieces.where("dataset_id is not null and first is not null").withColumn("reach", reach)
    return met.where("first <= reach").select("dataset_id", F.col("first").alias("start"), F.least("last", "reach").alias("stop"))


def _repeats(points: DataFrame, ranges: DataFrame, rows: int) -> DataFrame:
    """``(dataset_id, repeats)``: how many ids tasks share, over the tasks that have them, less one each.

    Only ids within the ranges move, once per task and packed: ids are mixed one-to-one, the upper bits deal them to buckets
    of about ``BATCH_IDS``, and the others travel as six bytes.
    """
    bits = max(0, min(16, (rows // BATCH_IDS).bit_length()))
    spark = points.sparkSession
    table: dict[str, list] = {}
    for r in ranges.collect() if ranges.count() <= BROADCAST_ROWS else ranges.groupBy("dataset_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).collect():
        table.setdefault(r["dataset_id"], []).append((r["start"], r["stop"]))
    known = spark.sparkContext.broadcast({d: _merged(sorted(v)) for d, v in table.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            encoded = batch.column("dataset_id").dictionary_encode()
            codes, ids = encoded.indices.to_numpy(zero_copy_only=False), batch.column("point_id").to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                name = encoded.dictionary[int(code)].as_py()
                if name in known.value:
                    own, (starts, stops) = ids[codes == code], known.value[name]
                    at = np.searchsorted(starts, own, side="right") - 1
                    held.setdefault(name, []).append(own[(at >= 0) & (own <= stops[at])])
        for name, ids in held.items():
            mixed = np.unique(dense.mixed(np.concatenate(ids)))
            bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mixed), np.int64)
            kept = mixed.view(np.uint8).reshape(-1, 8)[:, :6] if bits == 16 else mixed.view(np.uint8).reshape(-1, 8)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
            rows_ = [(name, int(bucket[a]), kept[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows_)) or [()] * 3, (pa.string(), pa.int64(), pa.binary()))], names=["dataset_id", "bucket", "ids"])

    def counted(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(b, dtype=f"V{6 if bits == 16 else 8}") for b in table.column("ids").to_pylist()])
        width = ids.dtype.itemsize
        whole = np.zeros((len(ids), 8), np.uint8)
        whole[:, :width] = ids.view(np.uint8).reshape(-1, width)
        return pa.table({"dataset_id": [table.column("dataset_id")[0].as_py()], "repeats": pa.array([len(ids) - len(np.unique(whole.view(np.uint64)))], pa.int64())})

    named = points.where("dataset_id is not null and point_id is not null").select("dataset_id", F.col("point_id").cast("bigint").alias("point_id"))
    packed = named.mapInArrow(run, "dataset_id string, bucket bigint, ids binary")
    found = packed.groupBy("dataset_id", "bucket").applyInArrow(counted, "dataset_id string, repeats bigint")
    return found.groupBy("dataset_id").agg(F.sum("repeats").alias("repeats"))


def _merged(ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    out: list[list[int]] = []
    for start, stop in ranges:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return np.array([r[0] for r in out], np.int64), np.array([r[1] for r in out], np.int64)


def point_report(points: DataFrame) -> DataFrame:
    """Shape and defects of every dataset (the null one included), with its first point's id and the tasks it is in.

    One narrow pass; ids are compared across tasks only where the ranges of two tasks overlap.
    """
    pieces = Workspace(points.sparkSession, "report").write(_pieces(points), "pieces")
    ranges = _shared_ranges(pieces)
    report = pieces.groupBy("dataset_id").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("min_dims"),
        F.max("hi").alias("max_dims"),
        F.sum("nulls").alias("null_rows"),
        F.sum("bad").alias("bad_values"),
        F.sum("null_ids").alias("null_ids"),
        F.sum("again").alias("again"),
        F.min("first").alias("first_id"),
        F.count("*").alias("tasks"),
    )
    if ranges.isEmpty():
        return report.withColumnRenamed("again", "repeated_ids")
    shared = _repeats(points, ranges, pieces.agg(F.max("n")).first()[0] * pieces.count())
    both = report.join(shared, "dataset_id", "left")
    return both.withColumn("repeated_ids", F.col("again") + F.coalesce("repeats", F.lit(0))).drop("again", "repeats")


def first_rows(points: DataFrame) -> DataFrame:
    """The point with the smallest id of every dataset."""
    least = points.groupBy("dataset_id").agg(F.min("point_id").alias("point_id"))
    return points.join(least, ["dataset_id", "point_id"], "left_semi")


def validate_points(points: DataFrame) -> DataFrame:
    """The report, raising when it is read if a dataset is uneven, has bad values, repeats an id, or a dataset or point has none."""
    r = point_report(points)
    sound = (
        F.col("dataset_id").isNotNull()
        & (F.col("min_dims") == F.col("max_dims"))
        & (F.col("null_rows") == 0)
        & (F.col("bad_values") == 0)
        & (F.col("null_ids") == 0)
        & (F.col("repeated_ids") == 0)
    )
    text = F.concat(
        F.lit("dataset "), F.coalesce("dataset_id", F.lit("null")), F.lit(": "),
        F.when(F.col("min_dims") < F.col("max_dims"), "points differ in dimension, ").otherwise(""), F.lit("dims "),
        F.coalesce("min_dims", F.lit(0)), F.lit(" to "), F.coalesce("max_dims", F.lit(0)),
        F.lit(", null rows "), F.col("null_rows"), F.lit(", bad values "), F.col("bad_values"), F.lit(", null ids "), F.col("null_ids"),
        F.lit(", repeated ids "), F.col("repeated_ids"),
    )
    return r.select(
        "dataset_id",
        F.when(F.coalesce(sound, F.lit(False)), F.col("n")).otherwise(F.raise_error(text).cast("bigint")).alias("n"),
        F.col("min_dims").alias("dims"),
        "first_id",
        "tasks",
    )


# --- row numbers --------------------------------------------------------------------------------


def row_index(
    df: DataFrame, order: list[str], within: tuple[str, ...] = (), name: str = "row", partitions: int | None = None
) -> DataFrame:
    """Number the rows from 1 in ``order``, separately for each value of ``within``; nulls come first.

    Only the keys are range-partitioned and sorted, ``within`` and ``order`` together, so one large group spreads over many
    tasks; each task numbers its keys and per-partition counts are added up.  The numbers are then joined back to the rows, which are
    never sorted.  Rows that ``order`` does not tell apart get numbers next to each other, in no fixed order.
    """
    spark, keys = df.sparkSession, [*within, *order]
    space = Workspace(spark, "rows")
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal keys are one row with a count
    runs = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    spread = runs.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    placed = space.write(spread.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    inside = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    totals = placed.groupBy(*within, "_part").agg(F.sum("_copies").alias("_n"))
    # one row per group and partition of the sort, so an ordered window is small
    window = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_shift"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)], F.col("_part") == F.col("_p"))
    ranks = placed.join(offsets, same).select(*keys, "_copies", (F.col("_before") + F.col("_shift") + 1).cast("bigint").alias(name))
    ranks = space.write(ranks, "ranks")
    repeated = ranks.where("_copies > 1")
    if not repeated.isEmpty():
        return _numbered_copies(df, ranks, keys, name)
    if set(df.columns) == set(keys):
        return ranks.select(*df.columns, name)
    return _with_rank(df, ranks.drop("_copies"), keys).select(*df.columns, name)


def _with_rank(df: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    other = ranks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in ranks.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return df.join(other.hint("shuffle_hash"), same)


def _numbered_copies(df: DataFrame, ranks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of one key numbered on from its first number; only rows whose key repeats are put in order."""
    both = _with_rank(df, ranks, keys)
    tie = Window.partitionBy(name, *keys).orderBy(F.lit(0))
    alone = both.where("_copies = 1").select(*df.columns, name)
    more = both.where("_copies > 1").withColumn(name, F.col(name) + F.row_number().over(tie) - 1)
    return alone.unionByName(more.select(*df.columns, name))


# --- leading rows -------------------------------------------------------------------------------


def first_n_frames(frames: DataFrame, n: int, dense: bool = False) -> DataFrame:
    """The first ``n`` frames of each trajectory in frame order: always ``n`` of them, or all if it has fewer.

    Null frame ids come last. Of frames with one id those with the smaller hash of their atoms come first; frames
    equal in both are taken for copies of one. Every task keeps the ``n + 1`` smallest ids of a trajectory, these are merged, and
    the ``n``-th filters the frames, which stay where they are.
    With ``dense`` the frame ids are known to count from 0, and a filter that reaches the scan is enough.
    """
    if n < 1:
        return frames.limit(0)
    if dense:
        return frames.where(F.col("frame_id") < n)
    space = Workspace(frames.sparkSession, "first")
    keys = frames.select("traj_id", F.col("frame_id").cast("bigint").alias("frame_id"))
    last = space.write(_nth(keys.withColumn("tie", F.lit(0).cast("bigint")), n), "last")  # a row per trajectory of more than n frames
    limits = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
    later = lambda a, b: (a.isNull() & b.isNotNull()) | F.coalesce(a > b, F.lit(False))
    named = limits.select(F.col("traj_id").alias("_traj"), F.col("frame_id").alias("_last"), "take", "tied", F.lit(True).alias("_long"))
    id_ = F.col("frame_id").cast("bigint")
    met = frames.join(named, F.col("traj_id").eqNullSafe(F.col("_traj")), "left")
    kept = met.where(F.col("_long").isNull() | ~later(id_, F.col("_last")))
    if last.where("tied").isEmpty():
        return kept.select(*frames.columns)
    at_last = F.coalesce(F.col("_long") & F.col("tied") & id_.eqNullSafe(F.col("_last")), F.lit(False))
    tied = kept.where(at_last).withColumn("_tie", F.xxhash64("atoms"))
    return kept.where(~at_last).select(*frames.columns).unionByName(_first_of_ties(tied, frames.columns, space))


def _first_of_ties(tied: DataFrame, columns: list[str], space: Workspace) -> DataFrame:
    """The first ``take`` rows of each trajectory among rows of one id, by ``_tie``; equal rows stand for each other."""
    copies = tied.groupBy("traj_id", "_tie").agg(F.count("*").alias("_copies"), F.first(F.struct(*columns)).alias("_row"), F.first("take").alias("_take"))
    before = Window.partitionBy("traj_id").orderBy("_tie").rowsBetween(Window.unboundedPreceding, -1)
    here = space.write(copies, "ties").withColumn("_left", F.col("_take") - F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    some = here.where("_left > 0").withColumn("_times", F.least("_left", "_copies").cast("int"))
    return some.select(F.explode(F.array_repeat("_row", F.col("_times"))).alias("_row")).select("_row.*")


def _nth(keys: DataFrame, n: int) -> DataFrame:
    """``(traj_id, frame_id, take, tied)`` of the ``n``-th id of each trajectory with more than ``n``: how many frames of
    that id are among the first ``n``, and whether there are more of them."""
    kind = keys.schema["traj_id"].dataType.simpleString()

    def smallest(held: dict, name, ids: np.ndarray, nulls: int) -> None:
        own = held.setdefault(name, [np.zeros(0, np.int64), 0])
        own[0] = np.concatenate([own[0], ids])
        if len(own[0]) > 4 * (n + 1):
            own[0] = np.partition(own[0], n)[: n + 1]
        own[1] = min(own[1] + nulls, n + 1)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            encoded = batch.column(0).dictionary_encode()
            codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                ids = batch.column(1).filter(pa.array(codes == code))
                smallest(held, None if code < 0 else encoded.dictionary[int(code)].as_py(), ids.drop_null().to_numpy(zero_copy_only=False), ids.null_count)
        for name, (ids, nulls) in held.items():
            ids = np.sort(ids)[: n + 1]
            ids = pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(min(nulls, n + 1 - len(ids)), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), batch.schema.field(0).type), ids], names=["traj_id", "frame_id"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kept(batches):
            if batch.num_rows > n:
                ids = batch.column(1).to_pylist()
                at = ids[n - 1]
                row = [[batch.column(0)[0].as_py()], [at], [sum(i == at for i in ids[:n])], [ids[n] == at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.bool_()))], names=["traj_id", "frame_id", "take", "tied"])

    schema = f"traj_id {kind}, frame_id bigint"
    heaps = keys.select("traj_id", "frame_id").mapInArrow(kept, schema).withColumn("_salt", F.spark_partition_id() % MERGE_PARTS)
    merged = heaps.repartition("traj_id", "_salt").select("traj_id", "frame_id").mapInArrow(kept, schema)
    return merged.repartition("traj_id").mapInArrow(last, f"{schema}, take bigint, tied boolean")
