"""Multi-scale planes over large point tables, as Spark jobs."""

from .operators.passes import Limits
from .operators.frames import superpose
from .plans.batch import fit_trajectories
from .plans.decompose import svd
from .plans.score import assignments, coords, leaf_of_point, level_error, project_points, reconstruct
from .plans.tree import fit
from .sources.model import export_vectors, load_coords, load_nodes, save_model
from .sources.points import as_points, read_points

__all__ = [
    "Limits",
    "as_points",
    "assignments",
    "coords",
    "export_vectors",
    "fit",
    "fit_trajectories",
    "leaf_of_point",
    "level_error",
    "load_coords",
    "load_nodes",
    "project_points",
    "read_points",
    "reconstruct",
    "save_model",
    "superpose",
    "svd",
]
