"""Embedding near-duplicates through spherical-cap filters.

Filter directions form a structured random product code: each is a pair of random unit vectors, one for either
half of the (randomly rotated) space, so ``k * k`` directions need ``2 * k`` products. A vector is listed under
every direction it exceeds the threshold for; these are found by walking the two sorted product lists, not by
trying all pairs. Vectors that share a filter are compared exactly in double precision.

The code's size and threshold follow from the number of vectors: a filter catches about ``STRAY`` unrelated
vectors of the largest label, and a pair at the wanted cosine shares ``SHARED`` filters on average.

Equal vectors are one class. A filter's members meet in blocks of bounded size; a pair counts in the first
filter it shares only. Blocks give sums and local stars, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestplane.llm.components import components
from nestplane.sources.shared import Workspace

COSINE = 0.93
SHARED = 20.0
STRAY = 0.25
STEEPEST = 5.0  # threshold in standard deviations, at most
PRODUCT = 16  # dimensions from which on the code is a product
BLOCK = 1024
SEED = 20240229


def both_exceed(least: float, cosine: float, dims: int) -> float:
    """Chance that a random unit direction has a product of ``least`` or more with both of two vectors at that cosine."""
    u = np.linspace(least, 1, 2001)[:, None]
    lowest = np.maximum((least - cosine * u) / math.sqrt(1 - cosine * cosine), -np.sqrt(1 - u * u))
    room = np.sqrt(np.maximum(0, 1 - u * u))
    v = lowest + (room - lowest) * np.linspace(0, 1, 801)[None, :]
    density = np.maximum(0, 1 - u * u - v * v) ** ((dims - 4) / 2) * (lowest < room)
    inner = np.trapezoid(density, v, axis=1)
    return float((dims - 2) / (2 * math.pi) * np.trapezoid(inner, u[:, 0]))


class Code:
    """Rotation, two lists of unit vectors, threshold. Below ``PRODUCT`` dimensions the second list is empty: plain directions."""

    def __init__(self, dims: int, vectors: int, cosine: float):
        rng = np.random.default_rng(SEED)
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        stray = min(0.2, STRAY / max(1, vectors))
        if dims < PRODUCT:
            u = unit(rng.standard_normal((400_000, dims)))
            self.least = float(np.quantile(u[:, 0], 1 - max(stray, 0.002))) - 1e-9
            other = cosine * u[:, 0] + (math.sqrt(1 - cosine * cosine) * u[:, 1] if dims > 1 else 0)
            self.cut, self.k = dims, math.ceil(SHARED / max(1e-4, float(((u[:, 0] >= self.least) & (other >= self.least)).mean())))
            self.left, self.right = unit(rng.standard_normal((self.k, dims))), np.zeros((1, 0))
            return
        self.least = min(STEEPEST, max(1.5, NormalDist().inv_cdf(1 - stray))) / math.sqrt(dims)
        self.k = max(2, math.ceil(math.sqrt(SHARED / both_exceed(self.least, cosine, dims))))
        self.cut = dims // 2
        # random directions of the whole space: each half carries its share of the length
        self.left = unit(rng.standard_normal((self.k, self.cut))) * math.sqrt(self.cut / dims)
        self.right = unit(rng.standard_normal((self.k, dims - self.cut))) * math.sqrt(1 - self.cut / dims)

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Numbers of all directions that each unit vector exceeds, ascending."""
        y = x @ self.rotation
        a, b = y[:, : self.cut] @ self.left.T, y[:, self.cut :] @ self.right.T
        out = []
        for p, q in zip(a, b, strict=True):
            order = np.argsort(-q)
            falling = q[order]
            first = np.flatnonzero(p >= self.least - falling[0])
            many = np.searchsorted(-falling, p[first] - self.least, side="right")
            found = [i * len(q) + order[:m] for i, m in zip(first.tolist(), many.tolist(), strict=True) if m]
            out.append(np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def usable(x):
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def listed(classes: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """``classes`` with ``x`` as unit vectors and the list of filters they exceed."""
    shared = classes.sparkSession.sparkContext.broadcast(codes)  # 2 * k vectors per dimension, k bounded by STEEPEST
    at = classes.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            units: list[np.ndarray] = [np.zeros(0)] * batch.num_rows
            size = np.diff(np.asarray(batch.column(at).offsets))
            for dims in np.unique(size):
                rows = np.flatnonzero(size == dims)
                x = matrix(batch.column(at).take(pa.array(rows)))
                x = unit(x / np.abs(x).max(axis=1, keepdims=True))
                for r, u, f in zip(rows, x, shared.value[int(dims)].filters(x), strict=True):
                    units[r], found[r] = u, f
            columns = [*batch.columns[:at], pa.array(units, pa.list_(pa.float64())), *batch.columns[at + 1 :], pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "filters"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))]))


class Met:
    """Rows of many block pairs as numpy arrays; the rows of a pair stand together."""

    def __init__(self, rows: pa.Table):
        plain = ("rep", "copies", "part", "filter", "p", "q")
        self.rep, self.copies, self.part, self.filter, self.p, self.q = (rows[c].to_numpy() for c in plain)
        self.x, self.at = flat(rows["x"])
        self.filters, self.cuts = flat(rows["filters"])

    def earlier(self, row: int) -> np.ndarray:
        """Filters of a row before the one it is met in."""
        own = self.filters[self.cuts[row] : self.cuts[row + 1]]
        return own[: np.searchsorted(own, self.filter[row])]


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each list begins."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(), np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy())])


def compare(met: Met, s: int, e: int, cosine: float):
    """``(member, links, star)`` of the block pair in rows ``s`` to ``e``: pairs that reach the cosine and share no earlier filter."""
    p, q, part = met.p[s], met.q[s], met.part[s:e]
    x = met.x[met.at[s] : met.at[e]].reshape(e - s, -1)
    if p == q:
        a = b = np.arange(e - s)
        hit = x @ x.T >= cosine
        np.fill_diagonal(hit, False)
    else:
        a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
        hit = x[a] @ x[b].T >= cosine
    if not hit.any():
        return None
    rows, cols = hit.any(axis=1), hit.any(axis=0)
    a, b, hit = a[rows], b[cols], hit[rows][:, cols]
    before = {i: met.earlier(s + i) for i in {*a.tolist(), *b.tolist()}}
    every = np.unique(np.concatenate(list(before.values())))
    if len(every):
        def marks(side):
            m = np.zeros((len(side), len(every)), dtype=np.float32)
            for r, i in enumerate(side.tolist()):
                m[r, np.searchsorted(every, before[i])] = 1
            return m

        hit &= marks(a) @ marks(b).T == 0
    if not hit.any():
        return None
    ids, copies = met.rep[s:e], met.copies[s:e].astype(np.float64)
    member = np.concatenate([a, b]) if p != q else a
    links = np.concatenate([hit @ copies[b], hit.T @ copies[a]]) if p != q else hit @ copies[b]
    la, lb = ids[a].copy(), ids[b].copy()
    top = np.iinfo(np.int64).max
    while True:  # smallest id reachable inside the blocks
        na = np.minimum(la, np.where(hit, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(hit, na[:, None], top).min(axis=0))
        if p == q:
            na = nb = np.minimum(na, nb)
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    star = np.concatenate([la, lb]) if p != q else la
    return ids[member], links.astype(np.int64), star


def verified(met: DataFrame, cosine: float) -> DataFrame:
    """Partial results of all block pairs; rows of a pair stand together in their partition."""
    keys = ["label", "dims", "filter", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        out: list = []

        def release():
            made = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["rep", "links", "star"])

        def judge(table: pa.Table, limits: list[int]) -> None:
            rows = Met(table)
            for s, e in zip(limits[:-1], limits[1:], strict=True):
                if e - s > 1 and (got := compare(rows, s, e, cosine)):
                    out.append(got)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            changes = np.zeros(held.num_rows, dtype=bool)
            for k in keys:
                v = held[k].to_numpy()
                changes[1:] |= v[1:] != v[:-1]
            limits = [0, *np.flatnonzero(changes).tolist()]
            if len(limits) > 1:
                judge(held.slice(0, limits[-1]), limits)
            held = held.slice(limits[-1])
            if out:
                yield release()
        if held is not None and held.num_rows:
            judge(held, [0, held.num_rows])
        if out:
            yield release()

    spread = met.repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "rep bigint, links bigint, star bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", x_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row.

    Rows are compared if their labels are equal and not null. Null or zero vectors and those with a null or
    non-finite component link with nothing, nor do vectors of different lengths. Equal vectors always link;
    other pairs at ``cosine`` or more are found with a recall set by ``SHARED`` and none below is. Repeated ids
    are rows of their own; a null id has a null component unless its vector has an id elsewhere.
    """
    space = Workspace(vectors.sparkSession, "caps")
    x = F.col(x_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & usable(F.col("x")))
    classes = rows.where("ok").groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = space.write(classes.withColumn("dims", F.size("x")), "classes")
    named = classes.where("rep is not null")
    sizes = named.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count").alias("n")).collect()  # a row per vector length
    codes = {r["dims"]: Code(r["dims"], r["n"], cosine) for r in sizes}
    found = space.write(listed(named, codes), "listed")
    entries = found.select("rep", "label", "dims", F.explode("filters").alias("filter"))
    buckets = entries.groupBy("label", "dims", "filter").count().where("count > 1")
    sized = entries.join(buckets, ["label", "dims", "filter"]).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    sized = space.write(sized.withColumn("part", part), "entries")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sized.select("rep", "filter", "part", others).select("rep", "filter", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    met = pairs.join(found, "rep").select("label", "dims", "filter", "p", "q", "part", "rep", "copies", "x", "filters")
    results = space.write(verified(met, cosine), "results")
    links = results.groupBy("rep").agg(F.sum("links").alias("links"))
    stars = components(results.where("rep <> star").select(F.col("rep").alias("a"), F.col("star").alias("b")), space)
    facts = classes.join(links, "rep", "left").join(stars.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("ok").join(facts, ["label", "x"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("id", id_col)
