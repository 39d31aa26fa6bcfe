"""Keyed matrix arithmetic.

A matrix is ``rows (row BIGINT, x ARRAY<DOUBLE>)`` or ``long (row BIGINT, dim BIGINT, value DOUBLE)``.
Rows are matched by key, never by position.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .passes import BLOCK, SALTS, Fields, Limits, attach, batch_of, ddl, matrix, segments
from .planes import node_centers
from ..sources.shared import Workspace

TILE = 256  # side of the square tiles of a distributed product
CHUNK = 4096  # columns per row of a transposed matrix


def _paired(a: DataFrame, b: DataFrame, combine) -> DataFrame:
    """Match rows by key; a row without a partner or of another length is an error, not a gap."""
    both = a.select("row", F.col("x").alias("ax")).join(b.select("row", F.col("x").alias("bx")), "row", "full")
    fits = F.coalesce(F.size("ax") == F.size("bx"), F.lit(False))
    trouble = F.concat(F.lit("matrices differ in shape at row "), F.col("row"))
    x = F.when(fits, combine(F.col("ax"), F.col("bx"))).otherwise(F.raise_error(trouble).cast("array<double>"))
    return both.select("row", x.alias("x"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, V.add)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, V.subtract)


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.select("row", V.scale(F.col("x"), factor).alias("x"))


def frobenius_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the root of the sum of squared differences."""
    squares = V.total(F.transform("x", lambda v: v * v))
    return subtract(a, b).agg(F.sqrt(F.sum(squares)).alias("distance"))


def row_means(a: DataFrame) -> DataFrame:
    return a.select("row", V.mean(F.col("x")).alias("mean"))


def subtract_row_scalar(a: DataFrame, scalars: DataFrame) -> DataFrame:
    """Subtract ``scalars (row, amount)`` from every entry of its row; a row without a partner is an error."""
    both = a.select("row", "x").join(scalars.select("row", "amount"), "row", "full")
    trouble = F.concat(F.lit("no partner for row "), F.col("row"))
    x = F.when(F.col("x").isNotNull() & F.col("amount").isNotNull(), V.shift(F.col("x"), F.col("amount")))
    return both.select("row", x.otherwise(F.raise_error(trouble).cast("array<double>")).alias("x"))


def column_means(points: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean vector of each dataset, summed inside every task before anything is shuffled."""
    return node_centers(points, limits).select("dataset_id", "center")


def center_columns(points: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Subtract the column means of each dataset, in a narrow pass while the means fit a broadcast."""
    centered = attach(points, column_means(points, limits), ["dataset_id"], limits=limits)
    return centered.withColumn("x", V.subtract(F.col("x"), F.col("center"))).drop("center")


def to_long(a: DataFrame) -> DataFrame:
    return V.to_long(a)


def transpose(long: DataFrame) -> DataFrame:
    """Swap the roles of rows and columns; in long form that is all there is to do."""
    return long.select(F.col("dim").cast("bigint").alias("row"), F.col("row").alias("dim"), "value")


def transposed_rows(long: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of the transpose, cut into chunks of ``chunk`` columns so that no row grows with the data.

    ``(row, chunk, dims, x)``: ``dims`` are the original row keys of the entries of ``x``, in order.
    """
    swapped = transpose(long).withColumn("chunk", _block_of("dim", chunk))
    entries = F.sort_array(F.collect_list(F.struct("dim", "value")))
    return swapped.groupBy("row", "chunk").agg(entries.alias("e")).select(
        "row", "chunk", F.transform("e", lambda e: e["dim"]).alias("dims"), F.transform("e", lambda e: e["value"]).alias("x")
    )


def _block_of(column: str, size: int):
    """Whole-number quotient rounded down, exact for every BIGINT."""
    size_ = F.lit(size).cast("bigint")
    return F.call_function("div", F.col(column) - F.pmod(F.col(column), size_), size_)


TILE_FIELDS: Fields = (("i", "bigint"), ("j", "bigint"), ("r", "int"), ("v", "array<double>"))


def _tiles(long: DataFrame, tile: int) -> DataFrame:
    """Long entries gathered into square tiles of at most ``tile * tile`` numbers."""
    size = F.lit(tile).cast("bigint")
    entry = F.struct(F.pmod("row", size).cast("int").alias("r"), F.pmod("dim", size).cast("int").alias("c"), "value")
    return long.groupBy(_block_of("row", tile).alias("ti"), _block_of("dim", tile).alias("tj")).agg(F.collect_list(entry).alias("entries"))


def multiply(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Product of two long matrices: ``sum_k a[i, k] b[k, j]``, absent entries counting as zero.

    Every row of ``a`` and column of ``b`` whose tiles meet has its entry, zero or not; NaN and infinite entries
    spread along their own row or column only.

    Tiles meet on the tile of the inner index, each pair is one dense product, and the products are
    added per output tile row.  Shuffled volume is that of the tiles, not of single entries.
    """
    left = _tiles(a, tile).select(F.col("ti").alias("i"), F.col("tj").alias("k"), F.col("entries").alias("ea"))
    right = _tiles(b, tile).select(F.col("ti").alias("k"), F.col("tj").alias("j"), F.col("entries").alias("eb"))

    def dense_tile(entries) -> np.ndarray:
        out = np.zeros((tile, tile))
        out[entries.field("r").to_numpy(), entries.field("c").to_numpy()] = entries.field("value").to_numpy()
        return out

    def products(batches):
        acc: dict[tuple[int, int], list] = {}  # product and the rows it has
        for batch in batches:
            ea, eb = batch.column("ea"), batch.column("eb")
            for at, (i, j) in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist())):
                rows, cols = np.zeros(tile, dtype=bool), np.ones(tile, dtype=bool)
                rows[ea[at].values.field("r").to_numpy()] = True
                cols[eb[at].values.field("c").to_numpy()] = False
                part = dense_tile(ea[at].values) @ dense_tile(eb[at].values)
                part[:, cols] = 0.0  # padding beyond the matrix, where NaN times zero would stand
                part[~rows] = 0.0
                held = acc.setdefault((i, j), [0.0, np.zeros(tile, dtype=bool)])
                held[0], held[1] = held[0] + part, held[1] | rows
                if len(acc) >= 256:
                    yield from _tile_rows(acc)
                    acc = {}
        yield from _tile_rows(acc)

    # few inner tiles (a tall left factor has one) would be few tasks: then outer tiles split the work as well
    right = Workspace(a.sparkSession, "product").write(right, "right")
    shape = right.agg(F.count_distinct("k").alias("k"), F.count_distinct("j").alias("j")).first()
    parts_j = max(1, min(shape["j"], SALTS)) if shape["k"] < SALTS else 1
    parts_i = -(-SALTS // parts_j) if shape["k"] < SALTS else 1
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumns({"si": own("i", parts_i), "sj": every(parts_j)})
    right = right.withColumns({"sj": own("j", parts_j), "si": every(parts_i)})
    pairs = left.join(right, ["k", "si", "sj"]).select("i", "j", "ea", "eb")
    summed = (
        pairs.mapInArrow(products, ddl(TILE_FIELDS))
        .groupBy("i", "j", "r")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    )
    entries = summed.select((F.col("i") * tile + F.col("r")).alias("row"), "j", F.posexplode("v").alias("c", "value"))
    entries = entries.select("row", (F.col("j") * tile + F.col("c")).alias("dim"), "value")
    return entries.join(b.select("dim").distinct(), "dim", "left_semi").select("row", "dim", "value")


def _tile_rows(acc: dict):
    for (i, j), (block, rows) in acc.items():
        used = np.flatnonzero(rows)
        if used.size:
            yield batch_of([(i, j, int(r), block[r]) for r in used], TILE_FIELDS)


def multiply_transposed(a: DataFrame, b: DataFrame, block: int = BLOCK, limits: Limits = Limits()) -> DataFrame:
    """Long form of ``A^T B`` for two tall matrices in row form.

    Rows meet by key and are multiplied where they meet, by pairs of column blocks; a task shuffles its sum of every pair
    once, whatever the number of rows. Where all pairs outgrow ``task_bytes``, the paired rows are read once for every group of pairs that
    does not, so no task holds the whole product. A row without a partner is an error.
    """
    fields: Fields = (("i", "int"), ("j", "int"), ("r", "int"), ("v", "array<double>"))
    wide = [m.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0] for m in (a, b)]
    pairs = [(i, j) for i in range(-(-wide[0] // block)) for j in range(-(-wide[1] // block))]
    groups = max(1, min(len(pairs), -(-wide[0] * wide[1] * 8 // limits.task_bytes)))

    def products(own: list[tuple[int, int]]):
        def run(batches):
            acc: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    x, y = matrix(batch.column("ax")), matrix(batch.column("bx"))
                    for i, j in own:
                        acc[i, j] = acc.get((i, j), 0.0) + x[:, i * block : (i + 1) * block].T @ y[:, j * block : (j + 1) * block]
            for (i, j), m in acc.items():
                yield batch_of([(i, j, r, line) for r, line in enumerate(m)], fields)

        return run

    both = a.select("row", F.col("x").alias("ax")).join(b.select("row", F.col("x").alias("bx")), "row", "full")
    alone = F.raise_error(F.concat(F.lit("no partner for row "), F.col("row"))).cast("array<double>")
    met = both.select(F.coalesce("ax", alone).alias("ax"), F.coalesce("bx", alone).alias("bx"))
    partials = reduce(DataFrame.unionByName, [met.mapInArrow(products(pairs[g::groups]), ddl(fields)) for g in range(groups)])
    summed = partials.groupBy("i", "j", "r").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return summed.select("i", "j", "r", F.posexplode("v").alias("c", "value")).select(
        (F.col("i").cast("bigint") * block + F.col("r") + 1).alias("row"), (F.col("j").cast("bigint") * block + F.col("c") + 1).alias("dim"), "value"
    )


def multiply_rows(a: DataFrame, small: np.ndarray) -> DataFrame:
    """Rows times a small dense matrix known to the driver, one narrow pass."""
    known = a.sparkSession.sparkContext.broadcast(np.asarray(small, dtype=np.float64))
    fields: Fields = (("row", "bigint"), ("x", "array<double>"))

    def run(batches):
        for batch in batches:
            for _, rows in segments(batch.column("x").value_lengths().to_numpy()):
                part = batch.take(pa.array(rows))
                product = matrix(part.column("x")) @ known.value
                yield batch_of(list(zip(part.column("row").to_pylist(), product)), fields)

    return a.select("row", "x").mapInArrow(run, ddl(fields))
