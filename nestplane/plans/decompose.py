"""The truncated SVD of point tables in one call."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..operators.passes import KEYS, Front, Limits, pin
from ..operators.split import CENTER_FIELDS, checked_size, level_bytes, root_centers
from ..operators.svd import PLANE_FIELDS, components, gram_planes, left_vectors, qr_planes
from ..sources.shared import Workspace
from .score import project_points


class Svd(NamedTuple):
    """``components (dataset_id, component, singular_value, v)`` and, if asked for, ``left (dataset_id, point_id, u)``."""

    components: DataFrame
    left: DataFrame | None


def svd(
    points: DataFrame,
    k: int,
    compute_u: bool = False,
    tol: float = dense.SCATTER_TOL,
    centered: bool = False,
    limits: Limits = Limits(),
) -> Svd:
    """Top ``k`` singular values and vectors of every dataset of ``points (dataset_id, point_id, x)``.

    Singular values of ``tol`` times the first or less are left out; below 1e-7 the decomposition goes by QR factors instead of the
    scatter matrix, whose eigenvalues are their squares. ``centered`` subtracts the column means first.
    """
    work = Workspace(points.sparkSession, "svd")
    shape = checked_size(points)
    front = Front(points, limits, work, tasks=shape["tasks"])
    centers = root_centers(front, shape["datasets"], shape["dims"])
    if not centered:
        centers = centers.map(lambda r: [(r["dataset_id"], r["node_id"], r["n"], np.zeros(len(r["center"])))], CENTER_FIELDS)
    nbytes = level_bytes(shape["datasets"], shape["dims"], k + 1)
    planes = qr_planes(front, centers, k, tol) if tol < dense.SCATTER_TOL else gram_planes(front, centers, k, tol)
    found = pin(planes, PLANE_FIELDS, nbytes, limits, work, "planes").df
    left = None
    if compute_u:
        roots = centers.df.select(*KEYS, "center").join(found, KEYS).withColumn("depth", F.lit(0))
        placed = project_points(points, roots, limits=limits)
        left = left_vectors(placed, found).select("dataset_id", "point_id", "u")
    return Svd(components(found).drop("node_id"), left)
