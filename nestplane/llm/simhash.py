"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree, in one of their two halves, up to one
bit. So every distinct fingerprint is indexed under 64 signatures: each half with each one of its 32
bits masked out. Fingerprints that share a signature are candidates and are verified on all 64 bits.

A signature that many fingerprints share (a large group of near copies) would give pairs with the
square of the group. There the pairs are found another, equally exact way: every fingerprint is
listed under the 65 values at distance one or less. Two fingerprints at distance two or less share
such a value, and all that share one are within two bits of each other, so a star replaces the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestplane.llm.components import components
from nestplane.llm.joins import beside
from nestplane.llm.text import tidy
from nestplane.sources.shared import Workspace

SEED = 42
MOST_BITS = 2
#: Signatures with more fingerprints than this are linked through shared neighbours; either way is exact.
CROWD = 8
#: Signatures of three fingerprints or more that may be broadcast (16 bytes each).
BROADCAST_KEYS = 2_000_000
BLOCK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of the XXH64 of every ``width``-word shingle; 0 if there is no word."""
    found = text.lower().split()  # bytes: only ASCII letters and white space are touched
    n = len(found) - width + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED) if found else 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp BIGINT)`` per row; a null, empty or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def _masked(half: int):
    """Signatures of one half of ``fp``: number of the masked bit above, the other 31 bits below."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) if half == 0 else F.shiftrightunsigned("fp", 32)
    keys = [F.lit((half * 32 + w) << 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << w)))) for w in range(32)]
    return keys


def signatures(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(*_masked(0), *_masked(1))).alias("key"))


def near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def links(fps: DataFrame, space: Workspace) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect exactly those linked by 2 or fewer bits."""
    shared = signatures(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = space.write(shared.where("n > 1"), "shared")
    twos = shared.where("n = 2").select("a", "b")
    crowded = shared.where("n > 2").select("key", "n")
    if crowded.count() <= BROADCAST_KEYS:  # else a shuffle of the signatures
        crowded = F.broadcast(crowded)
    several = signatures(fps).join(crowded, "key")
    several = space.write(several, "several")
    few = several.where(F.col("n") <= CROWD)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    crowd = several.where(F.col("n") > CROWD).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - ((1 << 64) if k == 63 else 0))) for k in range(64)])
    around = crowd.select("fp", F.explode(flips).alias("middle"))
    centre = around.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(centre.select("middle", "a"), "middle").where("fp <> a").select("a", F.col("fp").alias("b"))
    return twos.unionByName(pairs).where(near("a", "b")).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id_col, fp BIGINT, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest id among all rows reachable over links of 2 or fewer differing
    bits. Rows with equal fingerprints are one class, linked or not by text; null, empty and blank
    texts all have fingerprint 0. Rows with a null id stay and never name a component (a class of
    null ids only has a null component). An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "simhash")
    rows = space.write(fingerprints(docs, id_col, text_col, width), "rows")
    classes = space.write(rows.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    found = components(links(classes.select("fp"), space), space).withColumnRenamed("node", "fp")
    joined = space.write(found.join(classes, "fp"), "members")
    lowest = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = joined.join(lowest, "component").select("fp", "component_id")
    named = space.write(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "named")
    return beside(rows, named, ["fp"], ["id"]).select(F.col("id").alias(id_col), "fp", "component_id")
