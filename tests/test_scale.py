"""What the operators promise about nulls, ties, half-done work and the data they move."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import nestplane as N
from nestplane.functions import dense
from nestplane.operators import matrix as mx
from nestplane.operators import points as pt
from nestplane.operators import sketch as sk
from nestplane.operators import svd as sv
from nestplane.operators.passes import Front, Limits, NodeTable, ScatterFold, batch_of, node_pass
from nestplane.operators.split import CENTER_FIELDS, root_centers
from nestplane.plans import score
from nestplane.plans.decompose import svd
from nestplane.sources.shared import Workspace
from nestplane.streaming import moments as sm
from nestplane.streaming import score as ss
from nestplane.streaming.state import BatchState

WIDE = Limits(local_rows=0)
JOINED = Limits(local_rows=0, broadcast_bytes=0)


def cloud(n=120, dims=5, seed=3):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dims)) / np.arange(1, dims + 1)


# --- leading rows


def frames(spark, ids, atoms=None):
    rows = [("a", i, [[float(v)]]) for i, v in zip(ids, atoms or range(len(ids)))]
    return spark.createDataFrame(rows, "traj_id string, frame_id bigint, atoms array<array<double>>").repartition(3)


@pytest.mark.parametrize(
    "ids, n, want",
    [
        ([None, 1, 2], 2, [1, 2]),
        ([None, 1, 2], 3, [1, 2, None]),
        ([None, None, 1], 2, [1, None]),
        ([1, 1, 2], 1, [1]),
        ([1, 1, 1, 0], 3, [0, 1, 1]),
        ([5, 4, 3], 7, [3, 4, 5]),
        ([2, 1], 0, []),
    ],
)
def test_first_n_returns_n(spark, ids, n, want):
    got = [r.frame_id for r in pt.first_n_frames(frames(spark, ids), n).collect()]
    assert sorted(got, key=lambda i: (i is None, i)) == want


def test_first_n_of_equal_frames_and_null_trajectories(spark):
    same = frames(spark, [1] * 6, [0.0] * 6)
    assert pt.first_n_frames(same, 4).count() == 4
    nobody = same.withColumn("traj_id", F.lit(None).cast("string"))
    assert pt.first_n_frames(same.unionByName(nobody), 2).groupBy("traj_id").count().collect()[0]["count"] == 2
    # which of two different frames with one id comes is the same however they lie
    picks = {pt.first_n_frames(frames(spark, [1, 1, 1], [3.0, 1.0, 2.0]).repartition(p), 1).first().atoms[0][0] for p in (1, 2, 5)}
    assert len(picks) == 1


def test_first_n_sorts_nothing(spark):
    plan = pt.first_n_frames(frames(spark, list(range(50))), 5)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "Sort [" not in plan


# --- checks


@pytest.mark.parametrize("limits", [Limits(), WIDE], ids=["local", "wide"])
@pytest.mark.parametrize("row", [("all", None), (None, 7)])
def test_null_keys_raise_either_way(spark, limits, row):
    rows = [("all", i, [float(i), 1.0]) for i in range(6)] + [(*row, [2.0, 2.0])]
    points = spark.createDataFrame(rows, "dataset_id string, point_id bigint, x array<double>")
    with pytest.raises(Exception, match="null ids 1|dataset null"):
        N.fit(points, 1, 1, limits=limits).collect()


@pytest.mark.parametrize("scattered", [False, True])
def test_repeated_ids_are_found_across_tasks(spark, scattered):
    points = spark.range(0, 4000, 1, 4).select(F.lit("d").alias("dataset_id"), F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("x"))
    points = points.repartition(5) if scattered else points
    assert pt.validate_points(points).first().n == 4000
    again = points.unionByName(points.where("point_id in (3, 1999, 3999)"))
    report = pt.point_report(again).first()
    assert (report.n, report.repeated_ids) == (4003, 3)
    with pytest.raises(Exception, match="repeated ids 3"):
        pt.validate_points(again).collect()


def test_ids_in_order_are_not_shuffled(spark):
    points = spark.range(0, 4000, 1, 4).select(F.lit("d").alias("dataset_id"), F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("x"))
    pieces = pt._pieces(points)
    assert pieces.count() == 4 and pt._shared_ranges(pieces).isEmpty()


def test_points_of_an_unknown_dataset_come_back_unplaced(spark, make_points):
    nodes = N.fit(make_points(list(cloud(30))), 2, 2)
    new = make_points([("all", 1, cloud(30)[1]), ("other", 2, cloud(30)[2])])
    for limits in (Limits(), JOINED):
        got = [r for r in score.project_points(new, nodes, limits=limits).collect() if r.dataset_id == "other"]
        assert [(r.point_id, r.depth, r.node_id, r.coord) for r in got] == [(2, 0, None, None)]
        assert N.leaf_of_point(new, nodes, limits=limits).where("dataset_id = 'other'").first().node_id is None


# --- row numbers


def test_row_numbers_of_equal_keys_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("g", 5), ("g", 5), ("g", None), ("g", 9), (None, 2)], "g string, o int").withColumn("w", F.lit("x" * 50))
    got = sorted((r.g or "", -1 if r.o is None else r.o, r.row) for r in pt.row_index(df, ["o"], ("g",)).collect())
    assert got == [("", 1, 1), ("", 2, 2), ("g", -1, 1), ("g", 5, 2), ("g", 5, 3), ("g", 9, 4)]


def test_payload_is_not_sorted(spark):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 503).alias("o"), F.lit("payload").alias("w"))
    out = pt.row_index(df, ["o"])
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.o, r.row) for r in out.collect()) == [(o, i + 1) for i, o in enumerate(sorted(i * 7919 % 503 for i in range(500)))]


# --- level tables


def written(monkeypatch):
    """Rows of every table that is written while a test runs, by name."""
    rows, write = {}, Workspace.write

    def counting(self, df, name, by=None):
        stored = write(self, df, name, by)
        rows[name] = stored.count()
        return stored

    monkeypatch.setattr(Workspace, "write", counting)
    return rows


def test_level_tables_shrink_with_depth(make_points, monkeypatch):
    """Half of the points cannot be split any more after the first level, and nobody reads them again."""
    x = np.r_[cloud(60, 3) + 30.0, np.zeros((60, 3))]
    rows = written(monkeypatch)
    N.fit(make_points(list(x)), 1, 4, limits=Limits(local_rows=0, part_bytes=1)).collect()
    assert rows["level1-points"] == 120
    assert rows["level2-points"] <= 60 and rows["level3-points"] <= rows["level2-points"]


def test_a_pass_reads_the_parts_of_its_nodes(make_points):
    points = make_points(list(np.r_[cloud(40, 3), cloud(40, 3) + 50.0]))
    work = Workspace(points.sparkSession, "parts")
    front = Front(points, Limits(part_bytes=1), work)
    roots = root_centers(front, 1, 3)
    pairs = NodeTable(points.sparkSession, (("dataset_id", "string"), ("node_id", "bigint"), ("left", "array<double>"), ("right", "array<double>")),
                      held=pa.table({"dataset_id": ["all"], "node_id": [0], "left": [[0.0] * 3], "right": [[50.0] * 3]}))
    rows = [("all", 1, 40, np.zeros(3)), ("all", 2, 40, np.full(3, 50.0))]
    live = NodeTable(points.sparkSession, CENTER_FIELDS, held=pa.Table.from_batches([batch_of(rows, CENTER_FIELDS)]))
    none = live.where(lambda r: False)
    level, aside = front.extend(pairs, "moved").settle(live, none, 3, "level")
    assert aside is None and level.points.count() == 80 and level.directory == {("all", 1): 0, ("all", 2): 1}
    assert roots.held.num_rows == 1
    one = level.of_nodes({"all": {5: ()}})  # a child of node 2
    assert one.count() == 40
    assert "PartitionFilters" in one._jdf.queryExecution().toString() and {r.part for r in one.select("part").distinct().collect()} == {1}


# --- partial scatter matrices


def deep_front(spark, n=512, dims=530, nodes=256):
    """Points of a level of 256 nodes, depth 8."""
    x = cloud(n, dims, 5)
    rows = [("all", 255 + i % nodes, i, x[i].tolist()) for i in range(n)]
    points = spark.createDataFrame(rows, "dataset_id string, node_id bigint, point_id bigint, x array<double>").repartition(3)
    members = {j: x[[i for i in range(n) if 255 + i % nodes == j]] for j in range(255, 255 + nodes)}
    held = [("all", j, len(m), m.mean(axis=0)) for j, m in members.items()]
    centers = NodeTable(spark, CENTER_FIELDS, held=pa.Table.from_batches([batch_of(held, CENTER_FIELDS)]))
    return points, centers, members


def test_scatter_partials_are_never_larger_than_the_rows(spark):
    points, centers, members = deep_front(spark)
    front = Front(points, Limits(), Workspace(spark, "deep"), placed=True)
    sent = node_pass(front, ScatterFold(), centers).agg(F.sum(F.size("v"))).first()[0]
    assert sent <= 512 * 530
    got = {r.node_id: r for r in sv.gram_planes(front, centers, 1).where("node_id < 260").collect()}
    for j, r in got.items():
        want = dense.plane_of_rows(members[j] - members[j].mean(axis=0), 1)
        assert np.allclose(r.singular_values, want[0]) and np.allclose(r.basis, want[1], atol=1e-6)


@pytest.mark.parametrize("task_bytes", [256 << 20, 1])
def test_rows_and_blocks_make_one_scatter(spark, make_points, task_bytes):
    """Tasks with few points send rows, others blocks; with ``task_bytes`` of 1 the rows meet in slots first."""
    x = cloud(203, 8, 9)
    points = make_points(list(x), 40).coalesce(37)
    front = Front(points, Limits(task_bytes=task_bytes), Workspace(spark, "mixed"))
    centers = root_centers(front, 1, 8)
    entries = sv.scatter_entries(sv.scatter(front, centers)).collect()
    c = x - x.mean(axis=0)
    want = c.T @ c
    assert len(entries) == 36 and all(np.isclose(e.value, want[e.i - 1, e.j - 1]) for e in entries)


# --- decompositions


def test_qr_tree_keeps_small_singular_values(make_points, monkeypatch):
    monkeypatch.setattr(sv, "MERGED", 2)
    r = np.random.default_rng(4)
    u, _ = np.linalg.qr(r.normal(size=(90, 4)))
    v, _ = np.linalg.qr(r.normal(size=(4, 4)))
    x = (u * [1.0, 0.3, 4e-9, 2e-9]) @ v.T
    points = make_points(list(x), 7)
    rows = svd(points, 4, tol=1e-9).components.orderBy("component").collect()
    assert np.allclose([q.singular_value for q in rows], [1.0, 0.3, 4e-9, 2e-9], rtol=1e-5)
    assert svd(points, 4).components.count() == 2  # a scatter matrix cannot see them
    for q, want in zip(rows, v.T):
        assert abs(abs(np.dot(q.v, want)) - 1) < 1e-6


def test_probes_converge_or_raise(make_points):
    x = np.random.default_rng(8).normal(size=(300, 40))  # flat spectrum
    points = make_points(list(x))
    front = Front(points, Limits(), Workspace(points.sparkSession, "probes"))
    centers = root_centers(front, 1, 40)
    got = sv.components(sv.probe_planes(front, centers, 2, 1, 40, "p", oversample=4)).collect()
    want = dense.plane_of_rows(x - x.mean(axis=0), 2)
    assert np.allclose([r.singular_value for r in got], want[0]) and np.allclose([r.v for r in got], want[1], atol=1e-7)
    with pytest.raises(sv.NotConverged):
        sv.probe_planes(front, centers, 2, 1, 40, "q", oversample=4, passes=2)


def test_sketch_does_not_depend_on_partitions_and_keeps_its_bound(make_points):
    x = cloud(900, 12, 2) * 3
    found = [sk.sketch(make_points(list(x), p), 5, block_rows=200).collect() for p in (1, 6)]
    assert found[0] == found[1] and len(found[0]) == 1
    row = found[0][0]
    b = np.array(row["rows"]).reshape(-1, 12)
    assert row["n"] == 900 and len(b) <= 5 and np.isclose(row["squares"], (x * x).sum())
    gap = x.T @ x - b.T @ b
    w = np.linalg.eigvalsh(gap)
    assert w.min() > -1e-6 and w.max() <= row["shrunk"] + 1e-6
    assert row["shrunk"] * 6 <= (x * x).sum() - (b * b).sum() + 1e-6


@pytest.mark.parametrize("task_bytes", [256 << 20, 600])
def test_transposed_product_by_blocks(spark, task_bytes):
    a, b = cloud(50, 7, 1), cloud(50, 9, 2)
    rows = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "row bigint, x array<double>")
    got = mx.multiply_transposed(rows(a), rows(b), block=4, limits=Limits(task_bytes=task_bytes)).collect()
    out = np.zeros((7, 9))
    for r in got:
        out[r["row"] - 1, r["dim"] - 1] = r["value"]
    assert len(got) == 63 and np.allclose(out, a.T @ b)


# --- streams


def test_state_survives_replays_and_a_crash_before_the_mark(spark):
    path = Workspace(spark, "state").path
    state = BatchState(spark, path, "k int, n bigint")
    put = lambda i, n: state.put(spark.createDataFrame([(1, n)], "k int, n bigint"), i)
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    total = lambda: state.read().agg(F.sum("n")).first()[0]
    assert total() is None
    put(0, 10), put(1, 100)
    # a snapshot that nobody marked does not count
    merge(state.read(1)).write.parquet(f"{path}/_snapshots/upto=1")
    assert total() == 110 and state.upto() == -1
    state.compact(merge, 1)
    assert total() == 110 and state.upto() == 1
    put(1, 100)  # a replay of a batch that is in the snapshot
    assert total() == 110
    put(2, 1000)
    assert total() == 1110
    state.compact(merge, 2)
    state.compact(merge, 2)
    assert total() == 1110 and state.read().count() == 1


def test_moments_over_compacted_batches(spark, make_points):
    x = cloud(90, 6, 7)
    source = Workspace(spark, "arriving").path
    make_points(list(x), 5).write.parquet(source)
    path = Workspace(spark, "moments").path
    stream = spark.readStream.schema("dataset_id string, point_id bigint, x array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    limits = Limits(task_bytes=100)
    sm.run_moments(stream, f"{path}/s", f"{path}/c", shift=0.3, limits=limits, block=4, compact_every=2).awaitTermination()
    state = BatchState(spark, f"{path}/s", "n bigint")
    assert state.upto() >= 1
    got = sm.merged_moments(spark, f"{path}/s", shift=0.3).first()
    c = x - x.mean(axis=0)
    assert got.n == 90 and np.allclose(got.center, x.mean(axis=0)) and np.allclose(dense.unpack(np.array(got.scatter)), c.T @ c)


def test_stream_with_a_large_model(spark, make_points):
    points = make_points(list(cloud(40)))
    nodes = N.fit(points, 2, 2)
    source = Workspace(spark, "new-points").path
    points.write.parquet(source)
    stream = spark.readStream.schema("dataset_id string, point_id bigint, x array<double>").option("maxFilesPerTrigger", 2).parquet(source)
    path = Workspace(spark, "scored").path
    ss.score_stream(stream, nodes, f"{path}/out", f"{path}/progress", limits=JOINED).awaitTermination()
    key = lambda df: sorted((r.point_id, r.depth, r.node_id) for r in df.collect())
    assert key(spark.read.parquet(f"{path}/out")) == key(score.project_points(points, nodes))


# --- models


def test_a_half_written_model_does_not_load(spark, make_points):
    points = make_points(list(cloud(30, 3)))
    nodes, other = N.fit(points, 2, 1), N.fit(points, 2, 2)
    path = Workspace(spark, "half").path
    broken = N.coords(points, nodes).withColumn("point_id", F.raise_error(F.lit("stopped")).cast("bigint"))
    with pytest.raises(Exception, match="stopped"):
        N.save_model(path, nodes, broken)
    with pytest.raises(ValueError, match="saved to its end"):
        N.load_nodes(spark, path)
    N.save_model(path, nodes, N.coords(points, nodes))
    with pytest.raises(ValueError, match="holds a model"):
        N.save_model(path, other)
    with pytest.raises(Exception, match="stopped"):
        N.save_model(path, other, broken, mode="overwrite")
    assert N.load_nodes(spark, path).count() == nodes.count()  # still the first one
    assert N.load_coords(spark, path).count() == N.coords(points, nodes).count()
    N.save_model(path, other, mode="overwrite")
    assert N.load_nodes(spark, path).count() == other.count()
    with pytest.raises(ValueError, match="without coordinates"):
        N.load_coords(spark, path)
