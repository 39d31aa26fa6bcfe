"""The whole batch job over trajectories: align, take the first frames, flatten, fit, save.

All trajectories go through one job; the trajectory id is part of every grouping key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators.frames import superpose
from ..operators.passes import Limits
from ..operators.points import first_n_frames
from ..sources.model import save_model
from ..sources.points import flatten_frames
from .score import coords
from .tree import fit


def fit_trajectories(
    frames: DataFrame,
    path: str,
    d: int = 10,
    max_depth: int = 8,
    first_n: int | None = None,
    align_to: np.ndarray | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Fit every trajectory (its first ``first_n`` frames, if given), save nodes and coordinates under ``path``, and return the nodes."""
    chosen = frames if first_n is None else first_n_frames(frames, first_n)
    aligned = chosen if align_to is None else superpose(chosen, align_to)
    points = flatten_frames(aligned)
    nodes = fit(points, d, max_depth, limits=limits)
    save_model(path, nodes, coords(points, nodes, limits=limits))
    return nodes
