import numpy as np
import pytest
from pyspark.sql import functions as F

import nestplane as N
from nestplane.operators.passes import Limits
from nestplane.plans import score
from nestplane.sources.shared import Workspace

WIDE = Limits(local_rows=0)
JOINED = Limits(local_rows=0, broadcast_bytes=0)


def cloud(n=120, dims=5, seed=3):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dims)) / np.arange(1, dims + 1) + np.where(r.random((n, 1)) < 0.4, 3.0, 0.0)


def brute(x, d, max_depth, prune=0.99999, steps=10):
    """Straightforward tree on one machine, written against the definitions only."""
    found = {}

    def plane(p):
        c = p.mean(axis=0)
        _, s, vt = np.linalg.svd(p - c, full_matrices=False)
        keep = s > 1e-7 * s[0] if s[0] > 0 else s > 0
        rows = vt[:d][keep[:d]]
        return c, np.array([v * np.sign(v[np.argmax(np.abs(v))]) for v in rows]).reshape(-1, p.shape[1])

    def grow(node, ids, depth):
        c, b = plane(x[ids])
        found[node] = (len(ids), c, b)
        if depth == max_depth or len(ids) < 2:
            return
        far = lambda q: ids[np.argmax(np.round(((x[ids] - q) ** 2).sum(1), 10))]
        left, right = x[far(c)], None
        right = x[far(left)]
        if (left == right).all():
            return
        for _ in range(steps):
            side = ((x[ids] - right) ** 2).sum(1) < ((x[ids] - left) ** 2).sum(1)
            left, right = x[ids[~side]].mean(axis=0), x[ids[side]].mean(axis=0)
        side = ((x[ids] - right) ** 2).sum(1) < ((x[ids] - left) ** 2).sum(1)
        a, b2 = plane(x[ids[~side]])[1], plane(x[ids[side]])[1]
        k = min(len(a), len(b2))
        if k and (a[:k] * b2[:k]).sum() / np.sqrt((a * a).sum() * (b2 * b2).sum()) >= prune:
            return
        grow(2 * node + 1, ids[~side], depth + 1)
        grow(2 * node + 2, ids[side], depth + 1)

    grow(0, np.arange(len(x)), 0)
    return found


def as_dict(nodes):
    return {r.node_id: r for r in nodes.collect()}


def assert_same_tree(got, want):
    assert set(got) == set(want)
    for j, (n, c, b) in want.items():
        assert got[j].n == n
        assert np.allclose(got[j].center, c, atol=1e-9)
        assert np.allclose(np.array(got[j].basis).reshape(-1, len(c)), b, atol=1e-6)


@pytest.mark.parametrize("limits", [Limits(), WIDE, Limits(local_rows=60)], ids=["local", "wide", "mixed"])
def test_fit_equals_brute_force(make_points, limits):
    x = cloud()
    assert_same_tree(as_dict(N.fit(make_points(list(x)), 2, 3, steps=4, limits=limits)), brute(x, 2, 3, steps=4))


def test_joined_parameters_give_the_same_tree(make_points):
    x = cloud(40, 3)
    points = make_points(list(x))
    want = brute(x, 1, 2, steps=2)
    nodes = N.fit(points, 1, 2, steps=2, limits=JOINED)
    assert_same_tree(as_dict(nodes), want)
    # Nodes set aside for the last pass keep their points while others move on.
    assert_same_tree(as_dict(N.fit(points, 1, 2, steps=2, limits=Limits(local_rows=22, broadcast_bytes=0))), want)
    a = {(r.point_id, r.depth, r.node_id) for r in N.assignments(points, nodes, JOINED).collect()}
    b = {(r.point_id, r.depth, r.node_id) for r in N.assignments(points, nodes).collect()}
    assert a == b


def test_partitioning_does_not_matter(make_points):
    x = list(cloud())
    a, b = (as_dict(N.fit(make_points(x, p), 2, 1, limits=WIDE)) for p in (1, 7))
    assert set(a) == set(b)
    for j in a:
        assert a[j].n == b[j].n and np.allclose(a[j].basis, b[j].basis, atol=1e-9)


def test_mixed_datasets_of_very_different_size(make_points):
    """One dataset holds most rows and goes by passes; tiny ones are finished locally; one has one point."""
    big, small = cloud(150, 3, 1), cloud(12, 3, 2)
    rows = [("big", i, x) for i, x in enumerate(big)] + [("small", i, x) for i, x in enumerate(small)] + [("one", 5, small[0])]
    nodes = N.fit(make_points(rows), 2, 2, limits=Limits(local_rows=30)).cache()
    for name, x in (("big", big), ("small", small)):
        assert_same_tree(as_dict(nodes.where(F.col("dataset_id") == name)), brute(x, 2, 2))
    one = nodes.where("dataset_id = 'one'").collect()
    assert [(r.node_id, r.n, r.is_leaf, r.basis) for r in one] == [(0, 1, True, [])]


@pytest.mark.parametrize("limits", [Limits(), WIDE], ids=["local", "wide"])
def test_equal_points_are_a_leaf(make_points, limits):
    nodes = N.fit(make_points([[1.0, 2.0]] * 9), 2, 3, limits=limits).collect()
    assert [(r.node_id, r.n, r.is_leaf, r.split_cosine) for r in nodes] == [(0, 9, True, None)]


@pytest.mark.parametrize("limits", [Limits(), WIDE], ids=["local", "wide"])
def test_parallel_halves_are_pruned(make_points, limits):
    """Two parallel segments have the same line, so the split is dropped and its cosine kept on the parent."""
    xs = np.linspace(0, 1, 20)
    points = make_points([[v, 0.0, 0.0] for v in xs] + [[v, 50.0, 0.0] for v in xs])
    nodes = N.fit(points, 1, 3, limits=limits).collect()
    assert [(r.node_id, r.is_leaf) for r in nodes] == [(0, True)]
    assert nodes[0].split_cosine == pytest.approx(1.0) and nodes[0].split_left is None
    kept = N.fit(points, 1, 1, prune=2.0, limits=limits)
    assert sorted(r.node_id for r in kept.collect()) == [0, 1, 2]


def test_two_points(make_points):
    nodes = as_dict(N.fit(make_points([[0.0, 0.0], [1.0, 1.0]]), 2, 4, limits=WIDE))
    assert {j: r.n for j, r in nodes.items()} == {0: 2, 1: 1, 2: 1}
    assert nodes[0].split_cosine is None and not nodes[0].is_leaf  # empty planes cannot be compared


def test_wide_points_give_one_tree(make_points):
    x = np.random.default_rng(2).standard_normal((90, 530))
    by_passes = as_dict(N.fit(make_points(list(x)), 3, 1, steps=3, limits=WIDE))
    in_task = as_dict(N.fit(make_points(list(x)), 3, 1, steps=3))
    assert set(by_passes) == set(in_task)
    for j in in_task:
        assert np.allclose(np.array(by_passes[j].basis), np.array(in_task[j].basis), atol=1e-6)
        assert np.allclose(by_passes[j].singular_values, in_task[j].singular_values)


def test_invariants(make_points):
    x = cloud(200, 6)
    points = make_points(list(x))
    nodes = N.fit(points, 3, 3)
    rows = as_dict(nodes)
    for j, r in rows.items():
        b = np.array(r.basis)
        assert np.allclose(b @ b.T, np.eye(len(b)), atol=1e-9)
        if not r.is_leaf:
            assert r.n == rows[2 * j + 1].n + rows[2 * j + 2].n
    placed = N.assignments(points, nodes)
    counts = {r.node_id: r["count"] for r in placed.groupBy("node_id").count().collect()}
    assert counts == {j: r.n for j, r in rows.items()}
    for r in N.coords(points, nodes).collect():
        node = rows[r.node_id]
        assert np.allclose(r.coord, np.array(node.basis) @ (x[r.point_id] - node.center), atol=1e-9)
    errors = {r.depth: r for r in N.level_error(points, nodes).collect()}
    spread = ((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()
    assert errors[0].n == 200 and errors[0].mse <= spread
    for r in N.reconstruct(points, nodes).where("depth = 0").collect():
        node = rows[0]
        b = np.array(node.basis)
        assert np.allclose(r.rebuilt, node.center + b.T @ (b @ (x[r.point_id] - node.center)), atol=1e-9)


def test_descent_agrees_with_training_when_steps_converged(make_points):
    x = np.r_[cloud(40, 3, 5), cloud(40, 3, 6) + 20.0]
    points = make_points(list(x))
    nodes = N.fit(points, 1, 1)
    key = lambda df: {(r.point_id, r.depth, r.node_id) for r in df.collect()}
    assert key(N.assignments(points, nodes)) == key(score.place(points, nodes))


def test_tie_goes_left(make_points):
    nodes = N.fit(make_points([[-1.0, 0.0], [-1.0, 0.1], [1.0, 0.0], [1.0, 0.1]]), 1, 1, prune=2.0)
    middle = make_points([("all", 77, [0.0, 0.05])])
    assert N.leaf_of_point(middle, nodes).first().node_id == 1


def test_save_and_load(spark, make_points):
    points = make_points(list(cloud(30, 3)))
    nodes = N.fit(points, 2, 2)
    path = Workspace(spark, "test-model").path
    N.save_model(path, nodes, N.coords(points, nodes))
    back = N.load_nodes(spark, path)
    assert sorted(back.collect(), key=lambda r: r.node_id) == sorted(nodes.collect(), key=lambda r: r.node_id)
    assert N.load_coords(spark, path).count() == N.coords(points, nodes).count()
    points.select("dataset_id", "point_id").write.parquet(f"{path}/wrong/nodes")
    with pytest.raises(ValueError):
        N.load_nodes(spark, f"{path}/wrong")


def test_export_appends(spark, make_points):
    points = make_points(list(cloud(20, 3)))
    nodes = N.fit(points, 1, 1)
    path = Workspace(spark, "test-export").path
    for _ in range(2):
        N.export_vectors(path, nodes, N.coords(points, nodes), fmt="csv")
    assert spark.read.csv(path).count() == 2 * (3 * 3 + 3 * 3 + 20 * 2)
