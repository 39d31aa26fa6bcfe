
from __future__ import annotations

import os
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
if HERE not in sys.path:
    sys.path.insert(0, HERE)

import oracles  # noqa: E402
from nestplane.functions import heap  # noqa: E402
from nestplane.functions import vectors as V  # noqa: E402
from nestplane.operators import frames as fr  # noqa: E402
from nestplane.operators import matrix as mx  # noqa: E402
from nestplane.operators import planes as pl  # noqa: E402
from nestplane.operators import points as pt  # noqa: E402
from nestplane.operators import sketch as sk  # noqa: E402
from nestplane.operators import split as sp  # noqa: E402
from nestplane.operators import svd as sv  # noqa: E402
from nestplane.operators.passes import Limits  # noqa: E402
from nestplane.plans import score as sc  # noqa: E402
from nestplane.plans import tree as tr  # noqa: E402
from nestplane.plans.batch import fit_trajectories  # noqa: E402
from nestplane.plans.decompose import svd  # noqa: E402
from nestplane.sources import model as md  # noqa: E402
from nestplane.sources import points as src  # noqa: E402
from nestplane.sources.shared import Workspace  # noqa: E402
from nestplane.sources.ship import ship  # noqa: E402
from nestplane.streaming import moments as sm  # noqa: E402
from nestplane.streaming import score as ss  # noqa: E402
from nestplane.streaming import sketch as sks  # noqa: E402

EMBEDDING_SCHEMA = "vec_id bigint, embedding array<float>, label int"
WIDE = Limits(local_rows=0)  # every node by level-wide passes
JOINED = Limits(local_rows=0, broadcast_bytes=0)  # ... with node parameters joined, not broadcast

# --- inputs -------------------------------------------------------------------------------------


def harmonic(x):
    """Entry ``i`` divided by ``i``: a cloud whose leading directions are well apart."""
    return F.transform(x, lambda v, i: v / (i + 1))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("x", F.col("embedding").cast("array<double>"))


def plain(spark, sf):
    return src.as_points(embeddings(spark, sf), "vec_id", "x")


def scaled(spark, sf):
    return src.as_points(embeddings(spark, sf), "vec_id", harmonic(F.col("x")))


def by_label(spark, sf):
    return src.as_points(embeddings(spark, sf), "vec_id", harmonic(F.col("x")), F.col("label"))


def walkers(spark, sf):
    """New points for a tree fitted on ``scaled``: the vectors read backwards."""
    return src.as_points(embeddings(spark, sf), "vec_id", harmonic(F.reverse("x")))


def prices(spark, sf):
    """The largest table as four-dimensional points, one dataset per return flag."""
    x = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    return src.as_points(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", x, F.col("l_returnflag"))


def parts(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return src.as_points(part, "p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice"))


def frames(spark, sf, change=lambda x: x):
    e = embeddings(spark, sf)
    return src.as_frames(e, F.col("label"), F.col("vec_id"), src.atoms_of(change(F.col("x"))))


def a_rows(spark, sf):
    return embeddings(spark, sf).select(F.col("vec_id").alias("row"), "x")


def b_rows(spark, sf):
    return embeddings(spark, sf).select(F.col("vec_id").alias("row"), harmonic(F.col("x")).alias("x"))


# --- outputs ------------------------------------------------------------------------------------


def six(c, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def long(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Arrays as rows ``(keys, dim, value)``, rounded."""
    return V.to_long(df, keys[-1], x, tuple(keys[:-1])).withColumn("value", six("value"))


def tree_rows(nodes: DataFrame) -> DataFrame:
    """One row per number of a tree: node facts, then center, basis and singular values."""
    facts = [
        "dataset_id",
        "node_id",
        F.coalesce("parent_id", F.lit(-1)).cast("bigint").alias("parent_id"),
        "depth",
        F.coalesce("side", F.lit(-1)).alias("side"),
        "n",
        "is_leaf",
        six(F.coalesce("split_cosine", F.lit(2.0))).alias("split_cosine"),
    ]
    vectors = F.concat(
        F.array(F.struct(F.lit("center").alias("kind"), F.lit(0).alias("component"), F.col("center").alias("x"))),
        F.transform("basis", lambda b, k: F.struct(F.lit("basis").alias("kind"), (k + 1).alias("component"), b.alias("x"))),
        F.transform(
            "singular_values",
            lambda s, k: F.struct(F.lit("singular").alias("kind"), (k + 1).alias("component"), F.array(s).alias("x")),
        ),
    )
    rows = nodes.select(*facts, F.explode(vectors).alias("e"))
    kept = ["dataset_id", "node_id", "parent_id", "depth", "side", "n", "is_leaf", "split_cosine"]
    spread = rows.select(*kept, "e.kind", "e.component", F.posexplode("e.x").alias("p", "value"))
    return spread.select(*kept, "kind", "component", (F.col("p") + 1).cast("int").alias("dim"), six("value").alias("value"))


def coord_rows(placed: DataFrame, column: str = "coord") -> DataFrame:
    out = long(placed, ["dataset_id", "depth", "node_id", "point_id"], column)
    return out.withColumnRenamed("dim", "component") if column == "coord" else out


def plane_rows(components: DataFrame) -> DataFrame:
    return long(components.withColumn("singular_value", six("singular_value")), ["dataset_id", "node_id", "singular_value", "component"], "v")


# --- queries ------------------------------------------------------------------------------------


def points_scan(spark, sf):
    points = src.read_points(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    return long(points, ["dataset_id", "point_id"])


def frames_flatten(spark, sf):
    return long(src.flatten_frames(frames(spark, sf)), ["dataset_id", "point_id"])


def vector_dot(spark, sf):
    e = embeddings(spark, sf)
    return e.select(F.col("vec_id").alias("row"), six(V.dot(F.col("x"), harmonic(F.col("x")))).alias("value"))


def vector_distance(spark, sf):
    x = F.col("x")
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("row"), six(V.norm(x)).alias("norm"), six(V.distance(x, harmonic(x))).alias("distance")
    )


def matrix_scale(spark, sf):
    return long(mx.scale(a_rows(spark, sf), 2.5), ["row"])


def matrix_add(spark, sf):
    return long(mx.add(a_rows(spark, sf), b_rows(spark, sf)), ["row"])


def matrix_subtract(spark, sf):
    return long(mx.subtract(a_rows(spark, sf), b_rows(spark, sf)), ["row"])


def frobenius_distance(spark, sf):
    return mx.frobenius_distance(a_rows(spark, sf), b_rows(spark, sf)).select(six("distance").alias("distance"))


def row_means(spark, sf):
    return mx.row_means(a_rows(spark, sf)).select("row", six("mean", 8).alias("mean"))


def subtract_row_scalar(spark, sf):
    a = a_rows(spark, sf)
    means = mx.row_means(a).withColumnRenamed("mean", "amount")
    return long(mx.subtract_row_scalar(a, means), ["row"])


def center_columns(spark, sf):
    return long(mx.center_columns(by_label(spark, sf)), ["dataset_id", "point_id"])


def matrix_transpose(spark, sf):
    rows = mx.transposed_rows(mx.to_long(a_rows(spark, sf)))
    pairs = F.explode(F.arrays_zip("dims", "x")).alias("e")
    return rows.select("row", pairs).select("row", F.col("e.dims").alias("dim"), six("e.x").alias("value"))


def gram(spark, sf):
    """Transpose of A times B, 64 x 64."""
    return mx.multiply(mx.transpose(mx.to_long(a_rows(spark, sf))), mx.to_long(b_rows(spark, sf)))


def matrix_multiply(spark, sf):
    return gram(spark, sf).select("row", "dim", six("value").alias("value"))


def matrix_multiply_transposed(spark, sf):
    product = mx.multiply_transposed(a_rows(spark, sf), b_rows(spark, sf), block=16, limits=Limits(task_bytes=8 << 10))
    return product.select("row", "dim", six("value").alias("value"))


def matrix_multiply_chain(spark, sf):
    """A times (A^T B), both products distributed."""
    product = mx.multiply(mx.to_long(a_rows(spark, sf)), gram(spark, sf))
    return product.select("row", "dim", six("value").alias("value"))


def matrix_multiply_rows(spark, sf):
    """The same with the 64 x 64 factor on the driver."""
    small = np.zeros((64, 64))
    for r in mx.multiply_transposed(a_rows(spark, sf), b_rows(spark, sf)).collect():
        small[r["row"] - 1, r["dim"] - 1] = r["value"]
    return long(mx.multiply_rows(a_rows(spark, sf), small), ["row"])


def validate_points(spark, sf):
    points = by_label(spark, sf)
    checked = pt.validate_points(points).drop("tasks")
    first = pt.first_rows(points).select("dataset_id", "x")
    return long(checked.join(first, "dataset_id"), ["dataset_id", "n", "dims", "first_id"])


def row_index(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_retailprice")
    return pt.row_index(part, ["p_retailprice", "p_partkey"]).select("p_partkey", "row")


def row_index_by_group(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_orderkey")
    return pt.row_index(orders, ["o_orderkey"], ("o_orderpriority",))


def first_n_frames(spark, sf):
    chosen = pt.first_n_frames(frames(spark, sf), 30)
    return long(chosen.withColumn("x", F.flatten("atoms")), ["traj_id", "frame_id"])


def vector_sum(spark, sf):
    return long(pl.vector_sums(by_label(spark, sf)), ["dataset_id", "node_id", "n"], "total")


def node_centers(spark, sf):
    return long(pl.node_centers(by_label(spark, sf)), ["dataset_id", "node_id", "n"], "center")


def root_front(points: DataFrame):
    front = sp.Front(points, Limits(), Workspace(points.sparkSession, "roots"))
    shape = sp.size_of(points)
    return front, sp.root_centers(front, shape["datasets"], shape["dims"]), shape


def node_scatter(spark, sf):
    front, centers, shape = root_front(prices(spark, sf))
    entries = sv.scatter_entries(sv.scatter(front, centers))
    sizes = centers.df.select("dataset_id", "node_id", "n")
    return entries.join(sizes, ["dataset_id", "node_id"]).select(
        "dataset_id", "node_id", "i", "j", six(F.col("value") / F.col("n")).alias("value")
    )


def node_planes(spark, sf):
    front, centers, shape = root_front(prices(spark, sf))
    planes = sv.components(sv.planes(front, centers, 2))
    sized = planes.join(centers.df.select("dataset_id", "node_id", "n"), ["dataset_id", "node_id"])
    spread = sized.withColumn("spread", six(F.col("singular_value") / F.sqrt("n")))
    return long(spread, ["dataset_id", "node_id", "n", "spread", "component"], "v")


def svd_topk(spark, sf):
    front, centers, shape = root_front(scaled(spark, sf))
    wide = sv.planes(front, centers, 5)
    return plane_rows(sv.components(sv.first_components(wide, 2)))


def svd_randomized(spark, sf):
    front, centers, shape = root_front(scaled(spark, sf))
    return plane_rows(sv.components(sv.probe_planes(front, centers, 2, shape["datasets"], shape["dims"], "probe")))


def svd_randomized_flat(spark, sf):
    """Probes where the spectrum is flat: as many as it takes for small residuals."""
    front, centers, shape = root_front(plain(spark, sf))
    return plane_rows(sv.components(sv.probe_planes(front, centers, 2, shape["datasets"], shape["dims"], "probe")))


def svd_small_values(spark, sf):
    """Two columns that are parallel up to 1e-8: the second singular value is lost in a scatter matrix."""
    x = F.col("x")
    points = src.as_points(embeddings(spark, sf), "vec_id", F.array(x[0], x[0] + x[1] * 1e-8), F.col("label"))
    found = svd(points, 2, tol=1e-9).components.withColumn("node_id", F.lit(0).cast("bigint"))
    scaled_ = found.withColumn("singular_value", F.col("singular_value") * F.when(F.col("component") == 2, 1e8).otherwise(1.0))
    return plane_rows(scaled_)


def svd_sketch_bound(spark, sf):
    """A sketch of 16 of 64 directions: every column's energy, and whether what the sketch has of it keeps to its bounds."""
    k = 16
    found = sk.sketch(by_label(spark, sf), k, block_rows=128)
    energy = V.to_long(by_label(spark, sf), "point_id", "x", ("dataset_id",))
    whole = energy.groupBy("dataset_id", "dim").agg(F.sum(F.col("value") * F.col("value")).alias("whole"))
    both = sk.sketch_energy(found).join(whole.withColumn("dim", F.col("dim").cast("int")), ["dataset_id", "dim"])
    least, slack = F.col("whole") - F.col("energy"), F.lit(1e-9)
    within = (least >= -slack) & (least <= F.col("shrunk") + slack) & (F.col("shrunk") * (k + 1) <= F.col("slack") + slack)
    return both.select("dataset_id", "dim", six("whole").alias("energy"), within.alias("within"), (F.col("shrunk") > 0).alias("lossy"))


def svd_sketch(spark, sf):
    """Incremental SVD of centered points with room for the full rank, where it must agree with the exact one."""
    centered = mx.center_columns(by_label(spark, sf))
    found = sk.svd_sketch(centered, 2, oversample=62).withColumn("node_id", F.lit(0).cast("bigint"))
    return plane_rows(found)


def svd_by_group(spark, sf):
    return plane_rows(sv.components(tr.fit(by_label(spark, sf), 2, 0)))


def svd_left(spark, sf):
    points = scaled(spark, sf)
    nodes = tr.fit(points, 2, 0)
    left = sv.left_vectors(sc.coords(points, nodes), nodes)
    return long(left, ["dataset_id", "point_id"], "u").withColumnRenamed("dim", "component")


def two_means_centers(spark, sf):
    return long(sp.two_means_centers(by_label(spark, sf)), ["dataset_id", "side"], "center")


def two_means_assign(spark, sf):
    return sp.two_means_assign(by_label(spark, sf))


def two_means_split(spark, sf):
    return sp.two_means_split(parts(spark, sf)).select("dataset_id", "point_id", "node_id")


def split_sizes(spark, sf):
    return sp.split_sizes(sp.two_means_assign(parts(spark, sf)))


def node_counts(spark, sf):
    return pl.node_counts(sp.two_means_split(parts(spark, sf)))


def node_shapes(spark, sf):
    return pl.node_shapes(sp.two_means_split(parts(spark, sf)))


def fit_tree(spark, sf):
    """The tree by passes over all points and level tables, whatever its size."""
    return tree_rows(tr.fit(scaled(spark, sf), 2, 2, limits=WIDE))


def fit_tree_levelwise(spark, sf):
    """The same with a part of the level tables for every node."""
    return tree_rows(tr.fit(scaled(spark, sf), 2, 2, limits=Limits(local_rows=0, part_bytes=1)))


def fit_tree_joined(spark, sf):
    return tree_rows(tr.fit(scaled(spark, sf), 2, 2, limits=JOINED))


def fit_tree_local(spark, sf):
    """One level by passes, the rest by finishing each node in one task."""
    points = scaled(spark, sf)
    half = points.count() * 9 // 10
    return tree_rows(tr.fit(points, 2, 2, limits=Limits(local_rows=half)))


def expand_level(spark, sf):
    rows = tr.expand_roots(scaled(spark, sf), 2)
    blank = {"is_leaf": F.lit(None).cast("boolean"), "split_cosine": F.lit(None).cast("double")}
    return tree_rows(rows.withColumns(blank)).drop("is_leaf", "split_cosine")


def fit_by_dataset(spark, sf):
    return tree_rows(tr.fit(by_label(spark, sf), 2, 1, limits=WIDE))


def fit_pruned(spark, sf):
    return tree_rows(tr.fit(by_label(spark, sf), 2, 2, prune=0.9, limits=WIDE))


def fit_coords(spark, sf):
    points = scaled(spark, sf)
    return coord_rows(sc.coords(points, tr.fit(points, 2, 2, limits=WIDE)))


def fit_coords_uncentered(spark, sf):
    points = scaled(spark, sf)
    return coord_rows(sc.coords(points, tr.fit(points, 2, 2), centered=False))


def node_coords(spark, sf):
    points = by_label(spark, sf)
    return coord_rows(sc.coords(points, tr.fit(points, 2, 1)).where("depth = 1"))


def center_points(spark, sf):
    located = sp.two_means_split(by_label(spark, sf))
    centered = pl.center_points(located, pl.node_centers(located))
    return long(centered, ["dataset_id", "node_id", "point_id"])


def node_reconstruct(spark, sf):
    points = scaled(spark, sf)
    return coord_rows(sc.reconstruct(points, tr.fit(points, 2, 2)), "rebuilt")


def level_error(spark, sf):
    points = scaled(spark, sf)
    return sc.level_error(points, tr.fit(points, 2, 2)).withColumn("mse", six("mse", 8))


def level_max(spark, sf):
    return pl.level_max(tr.fit(scaled(spark, sf), 2, 2))


def tree_paths(spark, sf):
    node = F.col("node_id")
    return tr.fit(scaled(spark, sf), 2, 2).select(
        "dataset_id",
        "node_id",
        heap.depth(node).alias("depth"),
        F.coalesce(heap.parent(node), F.lit(-1)).cast("bigint").alias("parent_id"),
        F.coalesce(heap.side(node), F.lit(-1)).alias("side"),
        heap.level_offset(heap.depth(node)).alias("level_start"),
        F.posexplode(heap.path(node)).alias("step", "ancestor"),
    )


def sibling_cosine(spark, sf):
    return pl.sibling_cosine(tr.fit(scaled(spark, sf), 2, 2)).withColumn("split_cosine", six("split_cosine"))


def basis_trace(spark, sf):
    traces = pl.basis_traces(tr.fit(scaled(spark, sf), 2, 2))
    return traces.select("dataset_id", "node_id", *[six(c).alias(c) for c in ("trace_ab", "trace_aa", "trace_bb")])


def prune_splits(spark, sf):
    cosines = pl.sibling_cosine(tr.fit(by_label(spark, sf), 2, 2))
    return pl.prune_splits(cosines, 0.5).withColumn("split_cosine", six("split_cosine"))


def project_points(spark, sf):
    return coord_rows(sc.project_points(walkers(spark, sf), tr.fit(scaled(spark, sf), 2, 2)))


def project_points_joined(spark, sf):
    return coord_rows(sc.project_points(walkers(spark, sf), tr.fit(scaled(spark, sf), 2, 2), limits=JOINED))


def leaf_of_point(spark, sf):
    return sc.leaf_of_point(walkers(spark, sf), tr.fit(scaled(spark, sf), 2, 2))


def export_vectors(spark, sf):
    points = scaled(spark, sf)
    nodes = tr.fit(points, 2, 2)
    path = Workspace(spark, "export").path
    md.export_vectors(path, nodes, sc.coords(points, nodes))
    schema = "node_id bigint, kind string, component bigint, dim int, value double, dataset_id string"
    stored = spark.read.schema(schema).parquet(path)
    return stored.withColumn("value", six("value"))


def model_roundtrip(spark, sf):
    points = scaled(spark, sf)
    nodes = tr.fit(points, 2, 2)
    path = Workspace(spark, "model").path
    md.save_model(path, nodes, sc.coords(points, nodes))
    rows = md.vector_rows(md.load_nodes(spark, path), md.load_coords(spark, path))
    return rows.withColumn("value", six("value"))


def in_files(spark, sf, files: int = 4) -> str:
    """The embeddings dealt over some files, so that a stream of them has several batches."""
    path = f"{Workspace(spark, 'files').path}/embeddings"
    spark.read.parquet(f"{sf}/embeddings.parquet").repartition(files, "vec_id").write.parquet(path)
    return path


def arriving(spark, sf, x):
    stream = spark.readStream.schema(EMBEDDING_SCHEMA).option("maxFilesPerTrigger", 1).parquet(in_files(spark, sf))
    return src.as_points(stream, "vec_id", x, F.col("label"))


def stream_moments(spark, sf):
    """Four batches, folded into a snapshot after the second and the fourth; products by blocks of 16 of 64 columns, a few pairs a pass."""
    points = arriving(spark, sf, harmonic(F.col("embedding").cast("array<double>")))
    path, limits = Workspace(spark, "moments").path, Limits(task_bytes=8 << 10)
    sm.run_moments(points, f"{path}/sums", f"{path}/progress", shift=0.01, limits=limits, block=16, compact_every=2).awaitTermination()
    merged = sm.merged_moments(spark, f"{path}/sums", shift=0.01)
    both = sm.moments_plane(merged, 2).join(merged.select("dataset_id", "n", "center"), "dataset_id")
    spread = F.posexplode(F.arrays_zip("center", "v")).alias("p", "e")
    return both.select("dataset_id", "n", "component", six("singular_value").alias("singular_value"), spread).select(
        "dataset_id", "n", "component", "singular_value", (F.col("p") + 1).cast("int").alias("dim"),
        six("e.center").alias("center"), six("e.v").alias("value"),
    )


def stream_sketch(spark, sf):
    """Running SVD of uncentered points, with room for the full rank; a snapshot after the third of four batches."""
    points = arriving(spark, sf, harmonic(F.col("embedding").cast("array<double>")))
    path = Workspace(spark, "sketches").path
    sks.run_sketches(points, f"{path}/sketches", f"{path}/progress", 64, compact_every=3).awaitTermination()
    found = sk.sketch_components(sks.merged_sketch(spark, f"{path}/sketches", 64), 2)
    return plane_rows(found.withColumn("node_id", F.lit(0).cast("bigint")))


def stream_project(spark, sf):
    nodes = tr.fit(scaled(spark, sf), 2, 2)
    stream = sm.stream_points(spark, f"{sf}/embeddings.parquet", EMBEDDING_SCHEMA)
    points = src.as_points(stream, "vec_id", harmonic(F.reverse(F.col("embedding").cast("array<double>"))))
    path = Workspace(spark, "scores").path
    ss.score_stream(points, nodes, f"{path}/coords", f"{path}/progress").awaitTermination()
    stored = "dataset_id string, point_id bigint, depth int, node_id bigint, coord array<double>"
    return coord_rows(spark.read.schema(stored).parquet(f"{path}/coords"))


def frames_cross_cov(spark, sf):
    all_frames = frames(spark, sf)
    return fr.cross_covariance(all_frames, fr.reference_frame(all_frames)).withColumn("value", six("value"))


def frames_superpose(spark, sf):
    all_frames = frames(spark, sf)
    turned = fr.superpose(all_frames, fr.reference_frame(all_frames))
    atoms = turned.select("traj_id", "frame_id", F.posexplode("atoms").alias("a", "xyz"))
    return long(atoms.withColumn("atom", F.col("a") + 1), ["traj_id", "frame_id", "atom"], "xyz").withColumnRenamed("dim", "axis")


def fit_trajectory_files(spark, sf):
    """The batch job from frames to a saved model, read back."""
    path = Workspace(spark, "batch").path
    fit_trajectories(frames(spark, sf, harmonic), path, d=2, max_depth=1)
    return tree_rows(md.load_nodes(spark, path))


def fit_trajectories_aligned(spark, sf):
    """The same with every frame first turned onto the very first one."""
    every, path = frames(spark, sf), Workspace(spark, "batch").path
    fit_trajectories(every, path, d=2, max_depth=1, align_to=fr.reference_frame(every))
    return tree_rows(md.load_nodes(spark, path))


def svd_call(spark, sf):
    """The one-call SVD of uncentered points: components."""
    found = svd(by_label(spark, sf), 2).components
    return plane_rows(found.withColumn("node_id", F.lit(0).cast("bigint")))


def svd_call_left(spark, sf):
    """The one-call SVD of uncentered points: left vectors."""
    found = svd(by_label(spark, sf), 2, compute_u=True).left
    return long(found, ["dataset_id", "point_id"], "u").withColumnRenamed("dim", "component")


_QUERIES = {
    "points_scan": points_scan,
    "frames_flatten": frames_flatten,
    "vector_dot": vector_dot,
    "vector_distance": vector_distance,
    "matrix_scale": matrix_scale,
    "matrix_add": matrix_add,
    "matrix_subtract": matrix_subtract,
    "frobenius_distance": frobenius_distance,
    "row_means": row_means,
    "subtract_row_scalar": subtract_row_scalar,
    "center_columns": center_columns,
    "matrix_transpose": matrix_transpose,
    "matrix_multiply": matrix_multiply,
    "matrix_multiply_transposed": matrix_multiply_transposed,
    "matrix_multiply_chain": matrix_multiply_chain,
    "matrix_multiply_rows": matrix_multiply_rows,
    "validate_points": validate_points,
    "row_index": row_index,
    "row_index_by_group": row_index_by_group,
    "first_n_frames": first_n_frames,
    "vector_sum": vector_sum,
    "node_centers": node_centers,
    "node_scatter": node_scatter,
    "node_planes": node_planes,
    "svd_topk": svd_topk,
    "svd_randomized": svd_randomized,
    "svd_randomized_flat": svd_randomized_flat,
    "svd_small_values": svd_small_values,
    "svd_sketch": svd_sketch,
    "svd_sketch_bound": svd_sketch_bound,
    "svd_by_group": svd_by_group,
    "svd_left": svd_left,
    "svd_call": svd_call,
    "svd_call_left": svd_call_left,
    "two_means_centers": two_means_centers,
    "two_means_assign": two_means_assign,
    "two_means_split": two_means_split,
    "split_sizes": split_sizes,
    "node_counts": node_counts,
    "node_shapes": node_shapes,
    "fit_tree": fit_tree,
    "fit_tree_levelwise": fit_tree_levelwise,
    "fit_tree_local": fit_tree_local,
    "fit_tree_joined": fit_tree_joined,
    "expand_level": expand_level,
    "fit_by_dataset": fit_by_dataset,
    "fit_pruned": fit_pruned,
    "fit_coords": fit_coords,
    "fit_coords_uncentered": fit_coords_uncentered,
    "node_coords": node_coords,
    "center_points": center_points,
    "node_reconstruct": node_reconstruct,
    "level_error": level_error,
    "level_max": level_max,
    "tree_paths": tree_paths,
    "sibling_cosine": sibling_cosine,
    "basis_trace": basis_trace,
    "prune_splits": prune_splits,
    "project_points": project_points,
    "project_points_joined": project_points_joined,
    "leaf_of_point": leaf_of_point,
    "export_vectors": export_vectors,
    "model_roundtrip": model_roundtrip,
    "stream_moments": stream_moments,
    "stream_sketch": stream_sketch,
    "stream_project": stream_project,
    "frames_cross_cov": frames_cross_cov,
    "frames_superpose": frames_superpose,
    "fit_trajectories": fit_trajectory_files,
    "fit_trajectories_aligned": fit_trajectories_aligned,
}


def _shipping(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        df = query(spark, str(sf_dir).rstrip("/"))
        whole = {f.name: F.col(f.name).cast("bigint") for f in df.schema if f.dataType.simpleString() == "int"}
        return df.withColumns(whole) if whole else df

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def _corpus():
    """The corpus queries, if that subpackage can be imported."""
    try:
        import corpus_pipeline  # noqa: F401
        from nestplane.llm import queries as corpus
    except ImportError:
        return None
    return corpus


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    corpus = _corpus()
    return {name: _shipping(query) for name, query in _QUERIES.items()} | (corpus.QUERIES if corpus else {})


def oracle_sql() -> dict[str, str]:
    corpus = _corpus()
    return oracles.statements() | (corpus.ORACLE_SQL if corpus else {})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the tree of planes of the scaled embeddings."""
    return queries()["fit_tree"](spark, "/root/testdata/sf0.001")
