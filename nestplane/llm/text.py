"""Words and hashes of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

Nothing here sees more than one batch. Batches are cut into parts of a few MB at document limits, so a
task's memory follows the part, or its longest single document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PART_BYTES = 1 << 20
STEP = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
INVERSE = pow(STEP, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: 0-9, a-z and every byte of a character beyond ASCII.
WORD = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


#: Bytes of an Arrow batch between Spark and a Python worker; Spark's own default holds 64 MB on either side.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts stay small, so that workers and the buffers that feed them do (smaller settings stay)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m")).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """``run``, after which the worker, which Spark keeps for later tasks, gives free memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


class Part(NamedTuple):
    """Documents ``first`` to ``last`` of a batch: their bytes end to end and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each document: its first word, and at last the number of words


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[Part]:
    """The texts (null: empty) in parts of at most ``most`` bytes, or of one document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Part(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of ``member`` bytes inside each document."""
    n, inside = len(offsets) - 1, member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    limits = offsets[:-1][(offsets[:-1] < len(data))]
    begins[limits] = inside[limits]
    limits = limits[limits > 0] - 1
    ends[limits] = inside[limits]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    return Words(np.repeat(np.arange(n), np.diff(first)), start, np.flatnonzero(ends) + 1, first)


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        full = np.full(size, base, dtype=np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray, step: int = STEP) -> np.ndarray:
    """Weighted running sums from which the hash of any stretch follows in two look-ups."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.add(values, np.uint64(1), out=out[1:], dtype=np.uint64)
    out[1:] *= powers(step, len(values))
    np.cumsum(out, out=out)
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """64-bit hash of each stretch, equal for equal content wherever it stands."""
    h = (sums[end] - sums[start]) * powers(inverse, len(sums))[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    out = h ^ (h >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return stretch_hash(prefix_sums(data), w.start, w.end)


def distinct_pairs(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(document, feature)``, sorted; features (one row, or several of equal length) are below ``2 ** bits``."""
    kind = np.uint32 if doc.max(initial=0) < 1 << (32 - bits) else np.uint64  # half the bytes are sorted in half the time
    key = np.sort((doc.astype(kind) << kind(bits)) | feature.astype(kind), axis=None)
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) by document."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
