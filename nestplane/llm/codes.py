"""Product codes of vectors, trained and assigned in exact integers.

Components become integers; each vector is cut into parts, and every part position has a codebook trained by
rounds of k-means. Distances are exact whatever the components: integers are broken into limbs so
short that float64 matrix products of limbs are whole numbers below 2**53, and the products are put
together in int64. So ties are true ties, the first of them wins, and the result depends neither on the
partitioning nor on the machine. A round is one narrow pass; tasks emit sums per codebook entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestplane.sources.shared import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 8192  # vectors whose distances are held at once
#: Labels whose sums may be broadcast; beyond it they are joined, each label's rows dealt over ``SALTS`` parts.
BROADCAST_LABELS = 500_000
SALTS = 64


# --- exact products -----------------------------------------------------------------------------


def limb_bits(width: int) -> int:
    """Bits of a limb such that sums of ``width`` products of two limbs stay below 2**53."""
    return (53 - max(1, width - 1).bit_length() - 1) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices ``m_k`` with ``x = sum(m_k * 2**(bits * k))``; all but the last are not negative."""
    out, top = [], int(max(x.max(initial=0), -x.min(initial=0)))
    while top >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, top = x >> bits, (top >> bits) + 1
    return [*out, x.astype(np.float64)]


def dots(a: list[np.ndarray], b: list[np.ndarray], bits: int) -> np.ndarray:
    """``x @ y.T`` in int64 from the limbs of both; sums of equal place are added before the shift."""
    out = np.zeros((a[0].shape[0], b[0].shape[0]), dtype=np.int64)
    for place in range(len(a) + len(b) - 2, -1, -1):
        out <<= bits
        for k in range(max(0, place - len(b) + 1), min(place, len(a) - 1) + 1):
            out += (a[k] @ b[place - k].T).astype(np.int64)
    return out


def most_component(width: int) -> int:
    """Components up to this size have squared distances (and their parts) below 2**62."""
    return (1 << ((61 - max(1, width - 1).bit_length()) // 2 - 1)) - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of the nearest entry to each row, the first among equals."""
    bits = limb_bits(x.shape[1])
    right, own = limbs(book, bits), (book * book).sum(axis=1)
    entry, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for k in range(0, len(x), ROWS):
        rows = x[k : k + ROWS]
        rest = own - 2 * dots(limbs(rows, bits), right, bits)
        best = rest.argmin(axis=1)
        entry[k : k + ROWS] = best
        far[k : k + ROWS] = rest[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
    return entry, far


def cut(column: pa.Array, parts: int) -> list[np.ndarray]:
    """Integer vectors of one length as one matrix per part position."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    width = x.shape[1] // parts
    return [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(parts)]


# --- training -----------------------------------------------------------------------------------


def as_integers(vectors: DataFrame, id_col: str, x_col: str, label_col: str, scale: int) -> DataFrame:
    """``(id, label, v)`` of the rows whose vector and components are there and finite; ``v`` is floor(scale * x)."""
    x = F.col(x_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # far beyond what can be coded a component only has to stay beyond it
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(2.0**53)), F.lit(-(2.0**53)))).cast("bigint"))
    return vectors.where(x.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v"))


def partial_sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(part, entry, n, s)`` over all rows: how many are nearest to an entry, and their component sums."""
    shared, parts, width = rows.sparkSession.sparkContext.broadcast(books), len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value[0])
        n, s = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for p, x in enumerate(cut(batch.column(0), parts)):
                entry, _ = nearest(x, shared.value[p])
                order = np.argsort(entry, kind="stable")
                used, at = np.unique(entry[order], return_index=True)
                n[p] += np.bincount(entry, minlength=k)
                if len(used):
                    s[p, used] += np.add.reduceat(x[order], at, axis=0)
        p, e = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * width + 1, max(width, 1), dtype=np.int32)[: len(p) + 1]), pa.array(s[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), lists], names=["part", "entry", "n", "s"])

    found = rows.select("v").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    sums = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)


def train(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook per part position from integer vectors ``(id, v)`` of one ``length``.

    The first entries are the parts of the vectors with the smallest ids (null ids left out; of a repeated id the smaller
    vector first). An entry becomes the floor of the mean of its parts; one without parts stays. At most ``parts * entries`` rows reach the driver a round.
    """
    seeds = rows.where("id is not null").orderBy("id", "v").limit(entries).select("id", "v").collect()
    first = np.array([r["v"] for r in sorted(seeds, key=lambda r: (r["id"], r["v"]))], dtype=np.int64).reshape(len(seeds), length)
    width = length // parts
    books = [np.ascontiguousarray(first[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds if len(seeds) and width else 0):
        moved = [b.copy() for b in books]
        for r in partial_sums(rows, books).collect():
            moved[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        books = moved
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


# --- coding -------------------------------------------------------------------------------------


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(id, label, code, error)``: the nearest entries' indexes as hex digits, and the squared distances summed over parts."""
    shared, parts = rows.sparkSession.sparkContext.broadcast(books), len(books)
    digits = np.array([f"{k:02x}" for k in range(max(len(books[0]), 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, shared.value[p]) for p, x in enumerate(cut(batch.column(2), parts))]
            code = digits[found[0][0]]
            for entry, _ in found[1:]:
                code = np.char.add(code, digits[entry])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(sum(f for _, f in found))], names=["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    x_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, label, code, error, label_error)`` of every row with a usable vector, and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. The vectors' length is that of
    the smallest id's vector; a vector of another length, or with a component too large for exact distances in int64
    (``most_component``), keeps its row with a null code and error and trains nothing. So do all rows if no id is there or the length is
    no multiple of ``parts``. ``label_error`` is the sum of ``error`` over equal labels, null ones together. Rows of one id are rows of their own.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256, two hex digits")
    space = Workspace(vectors.sparkSession, "codes")
    whole = space.write(as_integers(vectors, id_col, x_col, label_col, scale), "integers")
    head = whole.where("id is not null").orderBy("id", "v").select(F.size("v").alias("n")).first()
    length = head["n"] if head and head["n"] % parts == 0 else 0
    top = most_component(max(1, length // parts))
    fits = (F.size("v") == (length or -1)) & ~F.exists("v", lambda c: F.abs(c) > top)
    able, rest = whole.where(fits), whole.where(~fits)
    books = train(able, length, parts, entries, rounds) if length else [np.zeros((0, 0), np.int64)] * parts
    none = {"code": F.lit(None).cast("string"), "error": F.lit(None).cast("bigint")}
    unable = rest.drop("v").withColumns(none)
    coded = encode(able, books).unionByName(unable) if len(books[0]) else whole.drop("v").withColumns(none)
    coded = space.write(coded, "codes")
    return with_label_sums(coded, space), books


def with_label_sums(coded: DataFrame, space: Workspace) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over its label."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = space.write(sums, "labels")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same, "left").drop("of")
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, same & (F.col("salt") == F.col("part")), "left").drop("of", "salt", "part")
