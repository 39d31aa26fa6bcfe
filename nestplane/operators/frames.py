"""Superposition of frames onto a reference structure (Kabsch, 1976).

A frame is one row, so centering, the nine covariance sums and the rotation never shuffle.  The
reference structure is a single frame, a few thousand numbers, sent to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passes import Fields, arrow_schema, ddl, segments


def reference_frame(frames: DataFrame) -> np.ndarray:
    """Atoms of the very first frame: least frame id of the least trajectory id."""
    first = frames.orderBy("traj_id", "frame_id").select("atoms").first()
    return np.asarray(first["atoms"], dtype=np.float64)


def _atoms(column: pa.Array) -> np.ndarray:
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1, 3)


def _centered(batch: pa.RecordBatch, reference: np.ndarray):
    """Rows of a batch by atom count, centered, with the centered reference."""
    target = reference - reference.mean(axis=0)
    for count, rows in segments(batch.column("atoms").value_lengths().to_numpy()):
        if count != len(reference):
            raise ValueError(f"a frame has {count} atoms, the reference {len(reference)}")
        part = batch.take(pa.array(rows)) if rows.size != batch.num_rows else batch
        x = _atoms(part.column("atoms"))
        yield part, x - x.mean(axis=1, keepdims=True), target


def cross_covariance(frames: DataFrame, reference: np.ndarray) -> DataFrame:
    """``(traj_id, frame_id, i, j, value)``: sums over atoms of centered frame times centered reference."""
    known = frames.sparkSession.sparkContext.broadcast(reference)
    schema = pa.schema([("traj_id", pa.string()), ("frame_id", pa.int64()), ("h", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for part, x, target in _centered(batch, known.value):
                h = np.einsum("nai,aj->nij", x, target).reshape(len(x), 9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, 9, dtype=np.int32)), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("traj_id"), part.column("frame_id"), lists], schema=schema)

    sums = frames.select("traj_id", "frame_id", "atoms").mapInArrow(run, "traj_id string, frame_id bigint, h array<double>")
    return sums.select("traj_id", "frame_id", F.posexplode("h").alias("p", "value")).select(
        "traj_id",
        "frame_id",
        (F.floor(F.col("p") / 3) + 1).cast("int").alias("i"),
        (F.col("p") % 3 + 1).cast("int").alias("j"),
        "value",
    )


def superpose(frames: DataFrame, reference: np.ndarray) -> DataFrame:
    """Frames moved by the proper rotation and shift that bring them closest to the reference."""
    known = frames.sparkSession.sparkContext.broadcast(reference)
    fields: Fields = (("traj_id", "string"), ("frame_id", "bigint"), ("atoms", "array<array<double>>"))
    schema = arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for part, x, target in _centered(batch, known.value):
                u, _, vt = np.linalg.svd(np.einsum("nai,aj->nij", x, target))
                flip = np.ones((len(x), 3))
                flip[:, 2] = np.sign(np.linalg.det(u @ vt))
                turned = x @ ((u * flip[:, None, :]) @ vt) + known.value.mean(axis=0)
                inner = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, turned.size + 1, 3, dtype=np.int32)), pa.array(turned.ravel())
                )
                outer = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, turned.size // 3 + 1, turned.shape[1], dtype=np.int32)), inner
                )
                yield pa.RecordBatch.from_arrays([part.column("traj_id"), part.column("frame_id"), outer], schema=schema)

    return frames.select("traj_id", "frame_id", "atoms").mapInArrow(run, ddl(fields))
