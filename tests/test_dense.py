import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nestplane.functions import dense


def test_left_wins_a_tie():
    x = np.array([[0.0, 5.0], [1.0, 0.0], [-1.0, 0.0]])
    assert dense.sides(x, np.array([-1.0, 0.0]), np.array([1.0, 0.0])).tolist() == [0, 1, 0]


def test_sides_far_from_origin():
    far = 1e7
    x = np.array([[far], [far + 1.0], [far + 0.5], [far + 0.500001]])
    assert dense.sides(x, np.array([far]), np.array([far + 1.0])).tolist() == [0, 1, 0, 1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 6))
def test_sides_equal_direct_distances(seed, n, d):
    r = np.random.default_rng(seed)
    x, a, b = r.integers(-3, 4, (n, d)).astype(float), r.integers(-3, 4, d).astype(float), r.integers(-3, 4, d).astype(float)
    direct = dense.squared_distances(x, b) < dense.squared_distances(x, a)
    assert (dense.sides(x, a, b) == direct).all()


def test_farthest_takes_smallest_id_among_equals():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.1, 0.1]])
    assert dense.farthest(x, np.array([9, 4, 7, 1]), np.zeros(2)) == 1


def test_mark_ignores_order_and_sees_a_swap():
    ids = np.arange(50)
    assert dense.mark(ids) == dense.mark(ids[::-1])
    assert dense.mark(ids) != dense.mark(np.r_[ids[:-1], 51])
    assert dense.mark(ids[:20]) ^ dense.mark(ids[20:]) == dense.mark(ids)


def test_pack_roundtrip():
    a = np.random.default_rng(1).normal(size=(7, 7))
    s = a @ a.T
    assert np.allclose(dense.unpack(dense.pack(s)), s)


def test_sign_is_canonical():
    rows = np.array([[0.6, -0.8], [-0.5, 0.5]])
    assert dense.signed(rows).tolist() == [[-0.6, 0.8], [0.5, -0.5]]


def test_rank_cut():
    x = np.outer(np.arange(5.0), [1.0, 2.0, 3.0])
    c = x - x.mean(axis=0)
    for s, rows in (dense.plane_of_rows(c, 2), dense.plane_of_scatter(c.T @ c, 2)):
        assert len(s) == len(rows) == 1
    s, rows = dense.plane_of_rows(np.zeros((4, 3)), 2)
    assert len(s) == len(rows) == 0


def test_cosine_of_empty_plane_is_unknown():
    assert dense.basis_cosine(np.zeros((0, 3)), np.eye(3)[:1]) is None
