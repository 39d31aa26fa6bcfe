import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import functions as F

import nestplane as N
from nestplane.functions import heap
from nestplane.functions import vectors as V
from nestplane.operators import frames as fr
from nestplane.operators import matrix as mx
from nestplane.operators import points as pt
from nestplane.operators import sketch as sk
from nestplane.operators import split as sp
from nestplane.operators import svd as sv
from nestplane.operators.passes import Limits
from nestplane.sources import points as src
from nestplane.sources.shared import Workspace
from nestplane.streaming import moments as sm
from nestplane.streaming import score as ss


def data(n=80, dims=5, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dims)) / np.arange(1, dims + 1)


def rows(spark, x, shift=0):
    return spark.createDataFrame([(i + shift, list(map(float, r))) for i, r in enumerate(x)], "row bigint, x array<double>")


def dense_of(long, shape):
    out = np.zeros(shape)
    for r in long.collect():
        out[r.row, r.dim - 1] = r.value
    return out


# --- vectors and heap ids


def test_uneven_vectors_give_null(spark):
    row = spark.sql("select array(1d, 2d) a, array(1d) b").select(V.dot(F.col("a"), F.col("b")).alias("v")).first()
    assert row.v is None


def test_heap_ids(spark):
    node = F.col("id")
    got = spark.range(0, 15).select(
        "id", heap.parent(node).alias("p"), heap.side(node).alias("s"), heap.depth(node).alias("d"), heap.path(node).alias("path")
    ).collect()
    for r in got:
        assert r.p == ((r.id - 1) // 2 if r.id else None)
        assert r.s == ((r.id + 1) % 2 if r.id else None)
        assert r.d == (r.id + 1).bit_length() - 1
        assert r.path[0] == 0 and r.path[-1] == r.id and len(r.path) == r.d + 1
    kids = spark.range(1).select(heap.child(F.lit(6), 0).alias("a"), heap.child(F.lit(6), 1).alias("b")).first()
    assert (kids.a, kids.b) == (13, 14)


# --- points


def test_validation_raises(spark, make_points):
    ok = pt.validate_points(make_points([[1.0, 2.0], [3.0, 4.0]])).first()
    assert (ok.n, ok.dims, ok.first_id) == (2, 2, 0)
    for bad in ([[1.0, 2.0], [3.0]], [[1.0, float("nan")]], [("all", 1, [1.0]), ("all", 1, [2.0])]):
        with pytest.raises(Exception, match="dataset all"):
            pt.validate_points(make_points(bad)).collect()


def test_uneven_points_stop_a_fit(make_points):
    with pytest.raises(Exception, match="differ in dimension"):
        N.fit(make_points([[1.0, 2.0], [3.0], [4.0, 5.0]], 1), 1, 1)


def test_row_index_spreads_one_large_group(spark):
    """A third of the rows and more in one group; numbers are those of a plain ordered list."""
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), ((F.col("id") * 7919) % 3001).alias("o")
    )
    got = pt.row_index(df, ["o"], ("g",), partitions=6).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.o, r.row))
    assert sum(map(len, by.values())) == 3000
    for pairs in by.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_first_n_dense_and_general_agree(spark):
    frames = spark.range(0, 40).select(
        (F.col("id") % 2).cast("string").alias("traj_id"), F.floor(F.col("id") / 2).alias("frame_id"), F.array(F.array(F.lit(0.0))).alias("atoms")
    )
    a, b = (pt.first_n_frames(frames, 7, dense=d).count() for d in (True, False))
    assert a == b == 14


def test_read_points_from_text(spark):
    path = Workspace(spark, "test-csv").path
    spark.range(4).selectExpr("id", "cast(id as double) a", "id * 2.0 b").write.csv(path, header=True)
    pts = N.read_points(spark, path, "id", ["a", "b"], fmt="csv", schema="id bigint, a double, b double", header="true")
    assert {r.point_id: r.x for r in pts.collect()}[3] == [3.0, 6.0]


# --- matrices


def test_sum_needs_the_same_shape(spark):
    a, b = data(5, 3), data(5, 3, 1)
    total = {r.row: r.x for r in mx.add(rows(spark, a), rows(spark, b)).collect()}
    assert np.allclose([total[i] for i in range(5)], a + b)
    for other in (rows(spark, b[:4]), rows(spark, b[:, :2]), rows(spark, b, 1)):
        with pytest.raises(Exception, match="differ in shape"):
            mx.add(rows(spark, a), other).collect()


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_product(spark, tile):
    a, b = data(7, 5), data(5, 4, 1)
    la, lb = mx.to_long(rows(spark, a)), mx.to_long(rows(spark, b, 1))  # inner index counts from 1 in both
    got = mx.multiply(la, lb, tile)
    assert np.allclose(dense_of(got, (7, 4)), a @ b)


def test_product_with_a_missing_row_counts_zero(spark):
    a, b = data(4, 3), data(3, 2, 1)
    lb = mx.to_long(rows(spark, b, 1)).where("row != 2")
    b[1] = 0.0
    assert np.allclose(dense_of(mx.multiply(mx.to_long(rows(spark, a)), lb, 2), (4, 2)), a @ b)


def test_transposed_product(spark):
    a, b = data(40, 3), data(40, 5, 1)
    got = mx.multiply_transposed(rows(spark, a).repartition(4), rows(spark, b))
    assert np.allclose(dense_of(got.withColumn("row", F.col("row") - 1), (3, 5)), a.T @ b)


def test_rows_times_small_matrix(spark):
    a, g = data(6, 3), data(3, 2, 1)
    got = {r.row: r.x for r in mx.multiply_rows(rows(spark, a), g).collect()}
    assert np.allclose([got[i] for i in range(6)], a @ g)


def test_transpose_twice_and_in_chunks(spark):
    a = data(9, 3)
    long = mx.to_long(rows(spark, a))
    assert {tuple(r) for r in mx.transpose(mx.transpose(long)).collect()} == {tuple(r) for r in long.collect()}
    chunks = mx.transposed_rows(long, chunk=4).collect()
    assert max(len(r.x) for r in chunks) == 4 and len(chunks) == 9
    for r in chunks:
        assert np.allclose(r.x, a[r.dims, r.row - 1])


# --- splits and SVD against Spark's own


def test_two_means_cost_close_to_spark_kmeans(spark, make_points):
    x = np.r_[data(60, 3), data(60, 3, 1) + 2.0]
    pts = make_points(list(x))
    side = {r.point_id: r.side for r in sp.two_means_assign(pts).collect()}
    s = np.array([side[i] for i in range(len(x))])
    cost = sum(((x[s == k] - x[s == k].mean(axis=0)) ** 2).sum() for k in (0, 1))
    model = KMeans(k=2, seed=50, maxIter=10).fit(pts.select(array_to_vector("x").alias("features")))
    assert cost <= 1.05 * model.summary.trainingCost


def test_early_stop_changes_nothing(spark, make_points):
    pts = make_points(list(data(70, 4)))
    many = {(r.point_id, r.side) for r in sp.two_means_assign(pts, steps=60).collect()}
    more = {(r.point_id, r.side) for r in sp.two_means_assign(pts, steps=61).collect()}
    assert many == more


def root(pts):
    front = sp.Front(pts, Limits(), Workspace(pts.sparkSession, "test"))
    return front, sp.root_centers(front, 1, 5)


def test_planes_equal_row_matrix_svd(spark, make_points):
    x = data()
    c = x - x.mean(axis=0)
    ours = {r.component: r for r in sv.components(sv.gram_planes(*root(make_points(list(x))), 3)).collect()}
    theirs = RowMatrix(spark.sparkContext.parallelize(c.tolist())).computeSVD(3)
    v = theirs.V.toArray()
    for k in range(3):
        assert ours[k + 1].singular_value == pytest.approx(theirs.s[k], rel=1e-9)
        assert abs(np.dot(ours[k + 1].v, v[:, k])) == pytest.approx(1.0, abs=1e-9)


def test_probe_equals_gram(make_points):
    front, centers = root(make_points(list(data(100, 30))))
    a = sv.gram_planes(front, centers, 2).first()
    b = sv.probe_planes(front, centers, 2, 1, 30, "t").first()
    assert np.allclose(a.basis, b.basis, atol=1e-5) and np.allclose(a.singular_values, b.singular_values, rtol=1e-9)


def test_sketch_is_exact_with_room_and_close_without(make_points):
    x = data(300, 12)
    pts = make_points(list(x), 5)
    s = np.linalg.svd(x, compute_uv=False)
    full = [r.singular_value for r in sk.svd_sketch(pts, 3, 9).orderBy("component").collect()]
    assert np.allclose(full, s[:3], rtol=1e-9)
    lossy = [r.singular_value for r in sk.svd_sketch(pts, 3, 3).orderBy("component").collect()]
    assert np.sum(np.square(lossy)) >= 0.98 * np.sum(s[:3] ** 2) and np.all(np.array(lossy) <= s[:3] * (1 + 1e-9))


def test_sketch_merge_order_within_bound(make_points):
    x = data(200, 6)
    for salts in (1, 8):
        parts = sk.sketch_partitions(make_points(list(x), 6), 6)
        got = sk.sketch_components(sk.merge_sketches(parts, 6, salts=salts), 6).orderBy("component").collect()
        assert np.allclose([r.singular_value for r in got], np.linalg.svd(x, compute_uv=False), rtol=1e-9)
        assert sk.merge_sketches(parts, 6, salts=salts).first().n == 200


# --- frames


def test_superpose_undoes_a_rigid_motion(spark):
    r = np.random.default_rng(4)
    ref = r.normal(size=(9, 3))
    turns = [np.linalg.qr(r.normal(size=(3, 3)))[0] for _ in range(6)]
    turns = [q * np.sign(np.linalg.det(q)) for q in turns]
    moved = [(ref @ q + r.normal(size=3)).tolist() for q in turns]
    frames = spark.createDataFrame([("t", i, m) for i, m in enumerate(moved)], "traj_id string, frame_id bigint, atoms array<array<double>>")
    for row in fr.superpose(frames, ref).collect():
        assert np.allclose(row.atoms, ref, atol=1e-9)


def test_superpose_never_mirrors(spark):
    ref = np.random.default_rng(5).normal(size=(8, 3))
    mirrored = (ref * [1, 1, -1]).tolist()
    frames = spark.createDataFrame([("t", 0, mirrored)], "traj_id string, frame_id bigint, atoms array<array<double>>")
    got = np.array(fr.superpose(frames, ref).first().atoms)
    rotation = np.linalg.lstsq(np.array(mirrored) - np.mean(mirrored, axis=0), got - got.mean(axis=0), rcond=None)[0]
    assert np.linalg.det(rotation) == pytest.approx(1.0)


def test_flatten_fills_the_last_atom(spark):
    df = spark.sql("select array(1d, 2d, 3d, 4d) x").select(src.atoms_of(F.col("x")).alias("atoms")).first()
    assert df.atoms == [[1.0, 2.0, 3.0], [4.0, 0.0, 0.0]]


# --- streams


def test_moments_over_several_batches_and_a_replay(spark, make_points):
    x = data(90, 4) + 100.0
    base = Workspace(spark, "test-stream").path
    make_points(list(x)).repartition(6).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("dataset_id string, point_id bigint, x array<double>").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    sm.run_moments(stream, f"{base}/sums", f"{base}/progress", shift=100.0).awaitTermination()
    first = spark.read.parquet(f"{base}/in").limit(1)
    again = sm.merged_moments(spark, f"{base}/sums", 100.0)
    row = again.first()
    c = x - x.mean(axis=0)
    assert row.n == 90 and np.allclose(row.center, x.mean(axis=0))
    assert np.allclose(row.scatter, (c.T @ c)[np.triu_indices(4)])
    # A replayed batch overwrites its own folder, so it cannot be counted twice.
    kept = spark.read.parquet(f"{base}/sums/batch_id=0").collect()
    spark.createDataFrame(kept, "dataset_id string, node_id bigint, block int, n bigint, mark bigint, v array<double>").write.mode("overwrite").parquet(f"{base}/sums/batch_id=0")
    assert sm.merged_moments(spark, f"{base}/sums", 100.0).first().n == 90
    plane = sm.moments_plane(sm.merged_moments(spark, f"{base}/sums", 100.0), 2).orderBy("component").collect()
    assert np.allclose([p.singular_value for p in plane], np.linalg.svd(c, compute_uv=False)[:2])
    assert first.count() == 1


def test_stream_scores_equal_batch_scores(spark, make_points):
    pts = make_points(list(data(50, 3)))
    nodes = N.fit(pts, 1, 2)
    base = Workspace(spark, "test-score").path
    pts.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(pts.schema).parquet(f"{base}/in")
    ss.score_stream(stream, nodes, f"{base}/out", f"{base}/progress").awaitTermination()
    key = lambda df: {(r.point_id, r.depth, r.node_id, round(r.coord[0], 9) if r.coord else None) for r in df.collect()}
    assert key(spark.read.parquet(f"{base}/out")) == key(N.project_points(pts, nodes))


def long_of(spark, array):
    entries = [(i, j, float(v)) for i, line in enumerate(array) for j, v in enumerate(line)]
    return spark.createDataFrame(entries, "row bigint, dim bigint, value double")


def test_product_keeps_zeros_and_spreads_nan_by_row(spark):
    a, b = np.array([[1.0, 0.0], [np.nan, 2.0], [0.0, 0.0]]), np.array([[0.0, 3.0], [4.0, np.inf]])
    got = {(r.row, r.dim): r.value for r in mx.multiply(long_of(spark, a), long_of(spark, b)).collect()}
    with np.errstate(invalid="ignore"):
        want = a @ b
    assert set(got) == {(i, j) for i in range(3) for j in range(2)}
    for (i, j), v in got.items():
        assert v == want[i, j] or (np.isnan(v) and np.isnan(want[i, j]))


@pytest.mark.parametrize("gap", [0, 1])
def test_rows_without_a_partner_raise(spark, gap):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "row bigint, x array<double>")
    one = a.where("row = 1")
    left, right = (a, one) if gap else (one, a)
    with pytest.raises(Exception, match="no partner for row 2"):
        mx.multiply_transposed(left, right).collect()
    with pytest.raises(Exception, match="no partner for row 2"):
        mx.subtract_row_scalar(left, right.selectExpr("row", "1.0d as amount")).collect()


def test_one_sketch_per_dataset_over_many_batches(spark):
    x = np.random.default_rng(4).standard_normal((600, 8))
    rows = [(f"d{i % 6}", i, v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "dataset_id string, point_id bigint, x array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        merged = sk.merge_sketches(sk.sketch_partitions(points, 8), 8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.dataset_id, r.n) for r in merged) == [(f"d{i}", 100) for i in range(6)]
    for r in merged:
        own = x[int(r.dataset_id[1:]) :: 6]
        assert np.allclose(np.linalg.norm(np.array(r.rows).reshape(-1, 8), axis=1), np.linalg.svd(own, compute_uv=False))


# --- sized joins, checks and the batch job


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0)])
def test_centering_is_the_same_broadcast_or_spread(spark, make_points, limits):
    x = data(60, 3)
    got = {r.point_id: r.x for r in mx.center_columns(make_points(x.tolist()), limits).collect()}
    assert len(got) == 60
    np.testing.assert_allclose([got[i] for i in range(60)], x - x.mean(axis=0), atol=1e-12)


def test_centering_moves_no_points(spark, make_points):
    """Without automatic broadcasts the points still stay where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mx.center_columns(make_points(data(20, 3).tolist()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("bad", [[("all", 1, [1.0]), ("all", 1, [2.0])], [[1.0], [float("inf")]], [[1.0], [float("nan")]]])
def test_unsound_points_stop_a_fit(make_points, bad):
    with pytest.raises(Exception, match="dataset all"):
        N.fit(make_points(bad), 1, 1)


def test_seed_partials_carry_no_vectors():
    from nestplane.operators.passes import FarFold

    assert all("array" not in kind for _, kind in FarFold.fields)


def test_first_n_sorts_keys_only(spark):
    frames = spark.range(0, 40).select(
        (F.col("id") % 2).cast("string").alias("traj_id"), (F.col("id") * 3).alias("frame_id"), F.array(F.array(F.col("id").cast("double"))).alias("atoms")
    )
    got = pt.first_n_frames(frames, 7)
    assert sorted((r.traj_id, r.frame_id) for r in got.collect()) == sorted((str(i % 2), i * 3) for i in range(14))
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert pt.first_n_frames(frames, 100).count() == 40 and pt.first_n_frames(frames, 0).count() == 0


def test_batch_job_aligned_and_cut(spark):
    """Rigid motions of one frame are one point once aligned; only the first frames count."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 3))
    rows = []
    for i in range(12):
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        turn[:, 0] *= np.sign(np.linalg.det(turn))
        moved = base @ turn + rng.normal(size=3) if i < 8 else rng.normal(size=(6, 3))
        rows.append(("t", i, (base if i == 0 else moved).tolist()))
    frames = spark.createDataFrame(rows, "traj_id string, frame_id bigint, atoms array<array<double>>")
    nodes = N.fit_trajectories(frames, Workspace(spark, "aligned").path, d=2, max_depth=0, first_n=8, align_to=base)
    root = nodes.first()
    assert root.n == 8
    np.testing.assert_allclose(np.reshape(root.center, (6, 3)), base, atol=1e-9)


def test_tall_product_meets_in_many_parts(spark):
    """A tall left factor has one inner tile, yet its rows spread over the parts of the outer one."""
    a, b = data(70, 3), data(3, 9, 1)
    got = mx.multiply(mx.to_long(rows(spark, a)), mx.to_long(rows(spark, b, 1)), tile=4)
    np.testing.assert_allclose(dense_of(got, (70, 9)), a @ b, atol=1e-12)
    assert "si#" in got._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("centered", [False, True])
def test_svd_call(make_points, centered):
    x = data(50, 4) + 1.0
    m = x - x.mean(axis=0) if centered else x
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    found = N.svd(make_points(x.tolist()), 3, compute_u=True, centered=centered)
    top = sorted(found.components.collect(), key=lambda r: r.component)
    np.testing.assert_allclose([r.singular_value for r in top], s[:3], rtol=1e-9)
    np.testing.assert_allclose(np.abs(np.sum(np.array([r.v for r in top]) * vt[:3], axis=1)), 1, atol=1e-9)
    left = np.array([r.u for r in sorted(found.left.collect(), key=lambda r: r.point_id)])
    np.testing.assert_allclose(np.abs(np.sum(left * u[:, :3], axis=0)), 1, atol=1e-9)
    assert N.svd(make_points(x.tolist()), 4, tol=0.9999).components.count() == 1
