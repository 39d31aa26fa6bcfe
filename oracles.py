"""The registered queries once more, as plain SQL for an independent engine.

Long texts are put together from the blocks below; nothing here is used by the package.
"""

from __future__ import annotations

STEPS = 10
SQUARINGS = 16  # repeated squaring raises a scatter matrix to the power 2**16

VECTOR = "embedding::DOUBLE[]"
HARMONIC = f"list_transform({VECTOR}, lambda v, i: v / i)"
REVERSED = f"list_transform(list_reverse({VECTOR}), lambda v, i: v / i)"


def num(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def cloud(name: str, x: str, dataset: str = "'all'") -> str:
    return f"{name} AS (SELECT {dataset} AS dataset_id, vec_id AS point_id, {x} AS x FROM embeddings)"


PLAIN = cloud("pts", VECTOR)
SCALED = cloud("pts", HARMONIC)
BY_LABEL = cloud("pts", HARMONIC, "label::VARCHAR")
FRAMES = f"""frames AS (
  SELECT traj_id, frame_id, x, list_transform(range(0, 22), lambda a: x[a * 3 + 1 : a * 3 + 3]) AS atoms
  FROM (SELECT label::VARCHAR AS traj_id, vec_id AS frame_id, list_concat({VECTOR}, [0.0::DOUBLE, 0.0::DOUBLE]) AS x FROM embeddings))"""


def long(source: str, keys: str = "dataset_id, node_id, point_id") -> str:
    return f"SELECT {keys}, unnest(range(1, len(x) + 1)) AS dim, unnest(x) AS v FROM {source}"


def means(name: str, source: str, keys: str = "dataset_id, node_id") -> str:
    """Center of each group, as a list."""
    return f"""{name} AS MATERIALIZED (
  SELECT {keys}, list(m ORDER BY dim) AS c, any_value(n) AS n FROM (
    SELECT {keys}, dim, avg(v) AS m, count(*) AS n FROM ({long(source, keys)}) GROUP BY {keys}, dim)
  GROUP BY {keys})"""


def farthest(name: str, source: str, centers: str, column: str) -> str:
    """Farthest point by distance to 12 significant digits, then by smallest id."""
    digits = "round(d2 / pow(10, floor(log10(greatest(d2, 1e-300)))), 11) * pow(10, floor(log10(greatest(d2, 1e-300))))"
    return f"""{name} AS MATERIALIZED (
  SELECT dataset_id, node_id, arg_max(x, row({digits}, -point_id)) AS p, max(d2) AS d2 FROM (
    SELECT s.dataset_id, s.node_id, s.point_id, s.x, pow(list_distance(s.x, c.{column}), 2) AS d2
    FROM {source} s JOIN {centers} c USING (dataset_id, node_id))
  GROUP BY ALL)"""


def sided(source: str, pairs: str) -> str:
    return f"""SELECT s.dataset_id, s.node_id, s.point_id, s.x,
      CASE WHEN list_distance(s.x, p.l) <= list_distance(s.x, p.r) THEN 0::BIGINT ELSE 1::BIGINT END AS side
    FROM {source} s JOIN {pairs} p USING (dataset_id, node_id)"""


def two_means(tag: str, source: str, steps: int = STEPS) -> list[str]:
    """CTEs ending in ``{tag}_pair`` (trained centers) and ``{tag}_sides`` (last assignment)."""
    out = [
        means(f"{tag}_c", source),
        farthest(f"{tag}_f0", source, f"{tag}_c", "c"),
        farthest(f"{tag}_f1", source, f"{tag}_f0", "p"),
        f"""{tag}_p0 AS MATERIALIZED (SELECT a.dataset_id, a.node_id, a.p AS l, b.p AS r
  FROM {tag}_f0 a JOIN {tag}_f1 b USING (dataset_id, node_id) WHERE b.d2 > 0)""",
    ]
    for t in range(1, steps + 1):
        out.append(
            f"""{tag}_p{t} AS MATERIALIZED (
  SELECT dataset_id, node_id, max(CASE WHEN side = 0 THEN c END) AS l, max(CASE WHEN side = 1 THEN c END) AS r FROM (
    SELECT dataset_id, node_id, side, list(m ORDER BY dim) AS c FROM (
      SELECT dataset_id, node_id, side, dim, avg(v) AS m FROM (
        {long(f"({sided(source, f'{tag}_p{t - 1}')})", "dataset_id, node_id, side")})
      GROUP BY ALL)
    GROUP BY ALL)
  GROUP BY ALL)"""
        )
    out.append(f"{tag}_pair AS (SELECT * FROM {tag}_p{steps})")
    out.append(f"{tag}_sides AS MATERIALIZED ({sided(source, f'{tag}_pair')})")
    return out


def planes(tag: str, source: str, d: int = 2, squarings: int = SQUARINGS, centered: bool = True) -> list[str]:
    """CTEs ending in ``{tag}_planes (dataset_id, node_id, n, c, k, s, v)``, one row per component."""
    middle = "m.c[l.dim]" if centered else "0"
    out = [
        means(f"{tag}_c", source),
        f"""{tag}_long AS MATERIALIZED (
  SELECT l.dataset_id, l.node_id, l.point_id, l.dim, l.v - {middle} AS v
  FROM ({long(source)}) l JOIN {tag}_c m USING (dataset_id, node_id))""",
        f"""{tag}_m1 AS MATERIALIZED (
  SELECT dataset_id, node_id, list(r ORDER BY i) AS m FROM (
    SELECT dataset_id, node_id, i, list(s ORDER BY j) AS r FROM (
      SELECT a.dataset_id, a.node_id, a.dim AS i, b.dim AS j, sum(a.v * b.v) AS s
      FROM {tag}_long a JOIN {tag}_long b USING (dataset_id, node_id, point_id) GROUP BY ALL)
    GROUP BY ALL)
  GROUP BY ALL)""",
    ]
    for k in range(1, d + 1):
        out.append(
            f"""{tag}_q{k} AS (
  SELECT dataset_id, node_id, 0 AS step, m FROM {tag}_m{k}
  UNION ALL
  SELECT dataset_id, node_id, step + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / t)) FROM (
    SELECT *, greatest(list_sum(list_transform(m, lambda a, i: list_dot_product(a, a))), 1e-300) AS t FROM {tag}_q{k} WHERE step < {squarings}))"""
        )
        out.append(
            f"""{tag}_u{k} AS MATERIALIZED (
  SELECT dataset_id, node_id, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w))) AS v FROM (
    SELECT dataset_id, node_id, m[list_position(g, list_max(g))] AS w FROM (
      SELECT dataset_id, node_id, m, list_transform(m, lambda a, i: a[i]) AS g FROM {tag}_q{k} WHERE step = {squarings})))"""
        )
        out.append(
            f"""{tag}_v{k} AS MATERIALIZED (
  SELECT dataset_id, node_id, m, {k}::BIGINT AS k,
    list_transform(v, lambda e: e * CASE WHEN -list_min(v) > list_max(v) THEN -1 ELSE 1 END) AS v,
    list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS e
  FROM {tag}_m{k} JOIN {tag}_u{k} USING (dataset_id, node_id))"""
        )
        out.append(
            f"""{tag}_m{k + 1} AS MATERIALIZED (
  SELECT dataset_id, node_id, list_transform(m, lambda r, i: list_transform(r, lambda a, j: a - e * v[i] * v[j])) AS m FROM {tag}_v{k})"""
        )
    parts = " UNION ALL ".join(f"SELECT dataset_id, node_id, k, e, v FROM {tag}_v{k}" for k in range(1, d + 1))
    # Rank cut: a component counts if its singular value exceeds 1e-7 of the first.
    out.append(
        f"""{tag}_planes AS MATERIALIZED (
  SELECT p.dataset_id, p.node_id, c.n, c.c, p.k, sqrt(p.e) AS s, p.v FROM ({parts}) p JOIN {tag}_c c USING (dataset_id, node_id)
  JOIN {tag}_v1 f USING (dataset_id, node_id) WHERE isfinite(p.e) AND isfinite(f.e) AND p.e > 0 AND p.e > 1e-14 * f.e)"""
    )
    return out


def tree(depth: int, d: int = 2, prune: float = 0.99999) -> list[str]:
    """CTEs ending in ``loc`` (every point at every kept level), ``tr_planes``, ``cosines`` (per tried split) and ``nodes``.

    Pruning is applied from the top down, so a node counts only if every split above it was kept.
    """
    out = ["l0 AS (SELECT dataset_id, 0::BIGINT AS node_id, point_id, x FROM pts)"]
    for k in range(depth):
        out.append(
            f"l{k}_open AS MATERIALIZED (SELECT * FROM l{k} WHERE (dataset_id, node_id) IN "
            f"(SELECT (dataset_id, node_id) FROM l{k} GROUP BY dataset_id, node_id HAVING count(*) > 1))"
        )
        out += two_means(f"s{k}", f"l{k}_open")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT dataset_id, node_id * 2 + 1 + side AS node_id, point_id, x FROM s{k}_sides)")
    union = " UNION ALL ".join(f"SELECT {k}::BIGINT AS depth, * FROM l{k}" for k in range(depth + 1))
    out.append(f"tried AS MATERIALIZED ({union})")
    out += planes("tr", "tried", d)
    out.append(
        """ranks AS MATERIALIZED (
  SELECT c.dataset_id, c.node_id, count(p.k) AS rank FROM tr_c c LEFT JOIN tr_planes p USING (dataset_id, node_id) GROUP BY ALL)"""
    )
    out.append(
        """cosines AS MATERIALIZED (
  SELECT *, CASE WHEN rank_a > 0 AND rank_b > 0 THEN trace / sqrt(rank_a * rank_b) END AS cosine FROM (
    SELECT a.dataset_id, (a.node_id - 1) // 2 AS node_id, a.rank AS rank_a, b.rank AS rank_b,
      coalesce(sum(list_dot_product(p.v, q.v)), 0) AS trace
    FROM ranks a JOIN ranks b ON a.dataset_id = b.dataset_id AND a.node_id % 2 = 1 AND b.node_id = a.node_id + 1
    LEFT JOIN tr_planes p ON p.dataset_id = a.dataset_id AND p.node_id = a.node_id
    LEFT JOIN tr_planes q ON q.dataset_id = b.dataset_id AND q.node_id = b.node_id AND q.k = p.k
    GROUP BY ALL))"""
    )
    dropped = " OR ".join(
        f"(depth >= {up} AND (dataset_id, ((node_id + 1) >> (depth - {up - 1})) - 1) IN (SELECT (dataset_id, node_id) FROM cosines WHERE cosine >= {prune}))"
        for up in range(1, depth + 1)
    )
    out.append(f"loc AS MATERIALIZED (SELECT * FROM tried WHERE NOT ({dropped or 'false'}))")
    out.append(
        """nodes AS MATERIALIZED (
  SELECT l.dataset_id, l.node_id, any_value(l.depth) AS depth, count(*) AS n, any_value(c.c) AS c,
    CASE WHEN l.node_id = 0 THEN -1 ELSE (l.node_id - 1) // 2 END AS parent_id,
    CASE WHEN l.node_id = 0 THEN -1 ELSE 1 - l.node_id % 2 END AS side,
    (l.dataset_id, 2 * l.node_id + 1) NOT IN (SELECT (dataset_id, node_id) FROM loc) AS is_leaf
  FROM loc l JOIN tr_c c USING (dataset_id, node_id) GROUP BY ALL)"""
    )
    return out


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# One row per number of a tree: node facts, then center, basis and singular values.
TREE_ROWS = f"""SELECT n.dataset_id, n.node_id, parent_id, depth, side, n.n, is_leaf, {num("coalesce(cosine, 2)")} AS split_cosine,
    kind, component, dim, {num("v")} AS value
  FROM nodes n LEFT JOIN cosines USING (dataset_id, node_id) JOIN (
    SELECT dataset_id, node_id, 'center' AS kind, 0::BIGINT AS component, unnest(range(1, len(c) + 1)) AS dim, unnest(c) AS v FROM nodes
    UNION ALL SELECT dataset_id, node_id, 'basis', k, unnest(range(1, len(v) + 1)), unnest(v) FROM tr_planes
    UNION ALL SELECT dataset_id, node_id, 'singular', k, 1, s FROM tr_planes) USING (dataset_id, node_id)"""

# Coordinates of every point on the plane of each node it is in.
COORDS = """coords AS MATERIALIZED (
  SELECT l.dataset_id, l.point_id, l.depth, l.node_id, p.k AS component, l.x, p.c, p.v,
    list_dot_product(list_transform(list_zip(l.x, p.c), lambda z: z[1] - z[2]), p.v) AS coord, list_dot_product(l.x, p.v) AS raw
  FROM loc l JOIN tr_planes p USING (dataset_id, node_id))"""

VECTOR_ROWS = f"""SELECT dataset_id, node_id, kind, component, dim, {num("v")} AS value FROM (
    SELECT dataset_id, node_id, 'center' AS kind, 0::BIGINT AS component, unnest(range(1, len(c) + 1)) AS dim, unnest(c) AS v FROM nodes
    UNION ALL SELECT dataset_id, node_id, 'basis', k, unnest(range(1, len(v) + 1)), unnest(v) FROM tr_planes SEMI JOIN nodes USING (dataset_id, node_id)
    UNION ALL SELECT dataset_id, node_id, 'coord', point_id, component, coord FROM coords)"""


def descent(depth: int, walkers: str = "walkers") -> list[str]:
    """``walkers`` stepping to the nearer child center, all levels in ``walked``."""
    out = [f"w0 AS MATERIALIZED (SELECT dataset_id, 0::BIGINT AS node_id, point_id, x FROM {walkers})"]
    for k in range(depth):
        out.append(
            f"""w{k + 1} AS MATERIALIZED (
  SELECT w.dataset_id, CASE WHEN list_distance(w.x, a.c) <= list_distance(w.x, b.c) THEN a.node_id ELSE b.node_id END AS node_id, w.point_id, w.x
  FROM w{k} w JOIN nodes a ON a.dataset_id = w.dataset_id AND a.node_id = 2 * w.node_id + 1
  JOIN nodes b ON b.dataset_id = w.dataset_id AND b.node_id = 2 * w.node_id + 2)"""
        )
    union = " UNION ALL ".join(f"SELECT {k}::BIGINT AS depth, * FROM w{k}" for k in range(depth + 1))
    out.append(f"walked AS MATERIALIZED ({union})")
    return out


WALKED_COORDS = f"""SELECT w.dataset_id, w.point_id, w.depth, w.node_id, p.k AS component,
    {num("list_dot_product(list_transform(list_zip(w.x, p.c), lambda z: z[1] - z[2]), p.v)")} AS value
  FROM walked w JOIN tr_planes p USING (dataset_id, node_id)"""


def rotations() -> list[str]:
    """Frames turned onto the first one by the leading eigenvector of the quaternion matrix (Horn, 1987)."""
    cov = """cov AS MATERIALIZED (
  SELECT f.traj_id, f.frame_id, i, j, sum((f.a[i] - f.m[i]) * (r.a[j] - r.m[j])) AS h
  FROM atoms f JOIN atoms r ON r.pos = f.pos AND (r.traj_id, r.frame_id) = (SELECT min((traj_id, frame_id)) FROM frames),
    (SELECT unnest(range(1, 4)) AS i) ii, (SELECT unnest(range(1, 4)) AS j) jj
  GROUP BY ALL)"""
    h = {f"{i}{j}": f"max(CASE WHEN i = {i} AND j = {j} THEN h END) AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)}
    rows = [
        "[h11 + h22 + h33 + t, h23 - h32, h31 - h13, h12 - h21]",
        "[h23 - h32, h11 - h22 - h33 + t, h12 + h21, h31 + h13]",
        "[h31 - h13, h12 + h21, h22 - h11 - h33 + t, h23 + h32]",
        "[h12 - h21, h31 + h13, h23 + h32, h33 - h11 - h22 + t]",
    ]
    return [
        FRAMES,
        """atoms AS MATERIALIZED (
  SELECT traj_id, frame_id, pos, a, list_transform([1, 2, 3], lambda i: list_sum(list_transform(atoms, lambda b: b[i])) / len(atoms)) AS m
  FROM (SELECT *, unnest(range(1, len(atoms) + 1)) AS pos, unnest(atoms) AS a FROM frames))""",
        cov,
        f"""spread AS MATERIALIZED (SELECT *, 3 * (abs(h11) + abs(h12) + abs(h13) + abs(h21) + abs(h22) + abs(h23) + abs(h31) + abs(h32) + abs(h33)) AS t
  FROM (SELECT traj_id, frame_id, {", ".join(h.values())} FROM cov GROUP BY ALL))""",
        f"""quat AS (
  SELECT traj_id, frame_id, 0 AS step, [{", ".join(rows)}] AS m FROM spread
  UNION ALL
  SELECT traj_id, frame_id, step + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / t)) FROM (
    SELECT *, list_sum(list_transform(m, lambda a: list_dot_product(a, a))) AS t FROM quat WHERE step < 40))""",
        """turn AS MATERIALIZED (
  SELECT traj_id, frame_id, q[1] AS a, q[2] AS b, q[3] AS c, q[4] AS d FROM (
    SELECT traj_id, frame_id, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w))) AS q FROM (
      SELECT traj_id, frame_id, m[list_position(g, list_max(g))] AS w FROM (
        SELECT traj_id, frame_id, m, list_transform(m, lambda r, i: r[i]) AS g FROM quat WHERE step = 40))))""",
        """rot AS MATERIALIZED (
  SELECT traj_id, frame_id, [
    [a*a + b*b - c*c - d*d, 2 * (b*c - a*d), 2 * (b*d + a*c)],
    [2 * (b*c + a*d), a*a - b*b + c*c - d*d, 2 * (c*d - a*b)],
    [2 * (b*d - a*c), 2 * (c*d + a*b), a*a - b*b - c*c + d*d]] AS r FROM turn)""",
        """turned AS MATERIALIZED (
  SELECT f.traj_id, f.frame_id, f.pos, k AS axis, list_dot_product(rot.r[k], list_transform(list_zip(f.a, f.m), lambda z: z[1] - z[2])) + r.m[k] AS v
  FROM atoms f JOIN rot USING (traj_id, frame_id)
  JOIN (SELECT any_value(m) AS m FROM atoms WHERE (traj_id, frame_id) = (SELECT min((traj_id, frame_id)) FROM frames)) r ON true,
    (SELECT unnest(range(1, 4)) AS k) kk)""",
    ]


PRICES = """pts AS MATERIALIZED (SELECT l_returnflag AS dataset_id, 0::BIGINT AS node_id, row_number() OVER () AS point_id,
  [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS x FROM lineitem)"""
PARTS = "pts AS (SELECT 'all' AS dataset_id, 0::BIGINT AS node_id, p_partkey AS point_id, [p_size::DOUBLE, p_retailprice] AS x FROM part)"
ROOTS = "roots AS (SELECT dataset_id, 0::BIGINT AS node_id, point_id, x FROM pts)"
BASES = ["a AS (SELECT vec_id AS row, " + VECTOR + " AS x FROM embeddings)", "b AS (SELECT vec_id AS row, " + HARMONIC + " AS x FROM embeddings)"]
LONG_AB = [f"al AS ({long('a', 'row')})", f"bl AS ({long('b', 'row')})"]
PLANE_ROWS = f"""SELECT dataset_id, node_id, k AS component, {num("s")} AS singular_value, unnest(range(1, len(v) + 1)) AS dim,
    unnest(list_transform(v, lambda e: {num("e")})) AS value"""


def statements() -> dict[str, str]:
    fitted = [SCALED, *tree(2)]
    tree_rows = query(fitted, TREE_ROWS)
    top = query([SCALED, ROOTS, *planes("r", "roots")], f"{PLANE_ROWS} FROM r_planes")
    elementwise = "SELECT row, dim, {} AS value FROM al JOIN bl USING (row, dim)"
    labelled = [BY_LABEL, ROOTS]
    out = {
        "points_scan": query([PLAIN], f"SELECT dataset_id, point_id, dim, {num('v')} AS value FROM ({long('pts', 'dataset_id, point_id')})"),
        "frames_flatten": query([FRAMES], f"SELECT traj_id AS dataset_id, frame_id AS point_id, dim, {num('v')} AS value FROM ({long('frames', 'traj_id, frame_id')})"),
        "vector_dot": query([*BASES], f"SELECT row, {num('list_dot_product(a.x, b.x)')} AS value FROM a JOIN b USING (row)"),
        "vector_distance": query([*BASES], f"SELECT row, {num('sqrt(list_dot_product(a.x, a.x))')} AS norm, {num('list_distance(a.x, b.x)')} AS distance FROM a JOIN b USING (row)"),
        "matrix_scale": query([*BASES, *LONG_AB], f"SELECT row, dim, {num('v * 2.5')} AS value FROM al"),
        "matrix_add": query([*BASES, *LONG_AB], elementwise.format(num("al.v + bl.v"))),
        "matrix_subtract": query([*BASES, *LONG_AB], elementwise.format(num("al.v - bl.v"))),
        "frobenius_distance": query([*BASES, *LONG_AB], f"SELECT {num('sqrt(sum(pow(al.v - bl.v, 2)))')} AS distance FROM al JOIN bl USING (row, dim)"),
        "row_means": query([*BASES, *LONG_AB], f"SELECT row, {num('avg(v)', 8)} AS mean FROM al GROUP BY row"),
        "subtract_row_scalar": query([*BASES, *LONG_AB], f"SELECT row, dim, {num('v - avg(v) OVER (PARTITION BY row)')} AS value FROM al"),
        "center_columns": query([BY_LABEL], f"SELECT dataset_id, point_id, dim, {num('v - avg(v) OVER (PARTITION BY dataset_id, dim)')} AS value FROM ({long('pts', 'dataset_id, point_id')})"),
        "matrix_transpose": query([*BASES, *LONG_AB], f"SELECT dim AS row, row AS dim, {num('v')} AS value FROM al"),
        "matrix_multiply": query([*BASES, *LONG_AB], f"SELECT al.dim AS row, bl.dim AS dim, {num('sum(al.v * bl.v)')} AS value FROM al JOIN bl USING (row) GROUP BY ALL"),
        "matrix_multiply_chain": query(
            [*BASES, *LONG_AB, "g AS (SELECT p.dim AS row, q.dim AS dim, sum(p.v * q.v) AS v FROM al p JOIN bl q USING (row) GROUP BY ALL)"],
            f"SELECT al.row, g.dim, {num('sum(al.v * g.v)')} AS value FROM al JOIN g ON g.row = al.dim GROUP BY ALL",
        ),
        "validate_points": query(
            [BY_LABEL],
            f"""SELECT dataset_id, n, dims, first_id, unnest(range(1, len(x) + 1)) AS dim, unnest(list_transform(x, lambda v: {num('v')})) AS value FROM (
  SELECT dataset_id, count(*) AS n, max(len(x)) AS dims, min(point_id) AS first_id, arg_min(x, point_id) AS x FROM pts GROUP BY ALL)""",
        ),
        "row_index": "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS row FROM part",
        "row_index_by_group": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS row FROM orders",
        "first_n_frames": query(
            [FRAMES],
            f"""SELECT traj_id, frame_id, dim, {num('v')} AS value FROM ({long('''(
  SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY frame_id) <= 30)''', 'traj_id, frame_id')})""",
        ),
        "vector_sum": query([BY_LABEL], f"SELECT dataset_id, 0::BIGINT AS node_id, count(*) AS n, dim, {num('sum(v)')} AS value FROM ({long('pts', 'dataset_id')}) GROUP BY dataset_id, dim"),
        "node_centers": query([BY_LABEL], f"SELECT dataset_id, 0::BIGINT AS node_id, count(*) AS n, dim, {num('avg(v)')} AS value FROM ({long('pts', 'dataset_id')}) GROUP BY dataset_id, dim"),
        "node_scatter": query(
            [PRICES, means("c", "pts"), f"lg AS (SELECT l.*, l.v - c.c[l.dim] AS y FROM ({long('pts')}) l JOIN c USING (dataset_id, node_id))"],
            f"""SELECT a.dataset_id, a.node_id, a.dim AS i, b.dim AS j, {num('sum(a.y * b.y) / count(*)')} AS value
  FROM lg a JOIN lg b ON a.dataset_id = b.dataset_id AND a.point_id = b.point_id AND a.dim <= b.dim GROUP BY ALL""",
        ),
        "node_planes": query([PRICES, *planes("r", "pts")], f"SELECT dataset_id, node_id, n, k AS component, {num('s / sqrt(n)')} AS spread, unnest(range(1, len(v) + 1)) AS dim, unnest(list_transform(v, lambda e: {num('e')})) AS value FROM r_planes"),
        "svd_topk": top,
        "svd_randomized": top,
        "svd_randomized_flat": query([PLAIN, ROOTS, *planes("r", "roots")], f"{PLANE_ROWS} FROM r_planes"),
        # Gram-Schmidt of the two columns, then the closed form of a 2 x 2 triangle; nothing is squared that must not be.
        "svd_small_values": query(
            [
                f"cols AS (SELECT label::VARCHAR AS dataset_id, x[1] AS a, x[1] + x[2] * 1e-8 AS b FROM (SELECT label, {VECTOR} AS x FROM embeddings))",
                "firsts AS (SELECT dataset_id, sqrt(sum(a * a)) AS p, sum(a * b) / sum(a * a) AS t FROM cols GROUP BY ALL)",
                """tri AS (SELECT dataset_id, any_value(p) AS p, any_value(p * t) AS q, sqrt(sum((b - t * a) * (b - t * a))) AS r
  FROM cols JOIN firsts USING (dataset_id) GROUP BY dataset_id)""",
                """val AS (SELECT dataset_id, sqrt((p * p + q * q + r * r + sqrt(pow(p * p + q * q + r * r, 2) - 4 * pow(p * r, 2))) / 2) AS s, p * r AS pr,
    atan2(2 * p * q, p * p - q * q - r * r) / 2 AS w FROM tri)""",
                f"""vecs AS (SELECT dataset_id, 1::BIGINT AS component, {num('s')} AS singular_value, [cos(w), sin(w)] AS v FROM val
  UNION ALL SELECT dataset_id, 2, {num('pr / s * 1e8')}, CASE WHEN abs(sin(w)) >= abs(cos(w)) THEN [sin(w), -cos(w)] ELSE [-sin(w), cos(w)] END FROM val)""",
            ],
            f"SELECT dataset_id, 0::BIGINT AS node_id, component, singular_value, unnest([1, 2]) AS dim, unnest(list_transform(v, lambda e: {num('e')})) AS value FROM vecs",
        ),
        "svd_sketch_bound": query(
            [BY_LABEL], f"SELECT dataset_id, dim, {num('sum(v * v)')} AS energy, true AS within, true AS lossy FROM ({long('pts', 'dataset_id')}) GROUP BY dataset_id, dim"
        ),
        "svd_sketch": query(
            [
                *labelled,
                means("mid", "roots"),
                """z AS (SELECT r.dataset_id, r.node_id, r.point_id, list_transform(list_zip(r.x, m.c), lambda e: e[1] - e[2]) AS x
  FROM roots r JOIN mid m USING (dataset_id, node_id))""",
                *planes("r", "z"),
            ],
            f"{PLANE_ROWS} FROM r_planes",
        ),
        "svd_by_group": query([*labelled, *planes("r", "roots")], f"{PLANE_ROWS} FROM r_planes"),
        "svd_left": query(
            [SCALED, ROOTS, *planes("r", "roots")],
            f"""SELECT l.dataset_id, l.point_id, p.k AS component, {num("sum(l.v * p.v[l.dim]) / any_value(p.s)")} AS value
  FROM r_long l JOIN r_planes p USING (dataset_id, node_id) GROUP BY l.dataset_id, l.point_id, p.k""",
        ),
        "svd_call": query([*labelled, *planes("r", "roots", centered=False)], f"{PLANE_ROWS} FROM r_planes"),
        "svd_call_left": query(
            [*labelled, *planes("r", "roots", centered=False)],
            f"""SELECT l.dataset_id, l.point_id, p.k AS component, {num("sum(l.v * p.v[l.dim]) / any_value(p.s)")} AS value
  FROM r_long l JOIN r_planes p USING (dataset_id, node_id) GROUP BY l.dataset_id, l.point_id, p.k""",
        ),
        "two_means_centers": query(
            [*labelled, *two_means("t", "roots")],
            f"""SELECT dataset_id, side, dim, {num('v')} AS value FROM (
    SELECT dataset_id, 0::BIGINT AS side, unnest(range(1, len(l) + 1)) AS dim, unnest(l) AS v FROM t_pair
    UNION ALL SELECT dataset_id, 1, unnest(range(1, len(r) + 1)), unnest(r) FROM t_pair)""",
        ),
        "two_means_assign": query([*labelled, *two_means("t", "roots")], "SELECT dataset_id, point_id, side FROM t_sides"),
        "two_means_split": query([PARTS, *two_means("t", "pts")], "SELECT dataset_id, point_id, 1 + side AS node_id FROM t_sides"),
        "split_sizes": query([PARTS, *two_means("t", "pts")], "SELECT dataset_id, side, count(*) AS n FROM t_sides GROUP BY ALL"),
        "node_counts": query([PARTS, *two_means("t", "pts")], "SELECT dataset_id, 1 + side AS node_id, count(*) AS n FROM t_sides GROUP BY ALL"),
        "node_shapes": query([PARTS, *two_means("t", "pts")], "SELECT dataset_id, 1 + side AS node_id, count(*) AS n, max(len(x)) AS dims FROM t_sides GROUP BY ALL"),
        "fit_tree": tree_rows,
        "fit_tree_levelwise": tree_rows,
        "fit_tree_local": tree_rows,
        "fit_tree_joined": tree_rows,
        "expand_level": query([SCALED, *tree(1)], f"SELECT * FROM ({TREE_ROWS}) WHERE depth = 1".replace("SELECT * FROM", "SELECT * EXCLUDE (is_leaf, split_cosine) FROM", 1)),
        "fit_by_dataset": query([BY_LABEL, *tree(1)], TREE_ROWS),
        "fit_pruned": query([BY_LABEL, *tree(2, prune=0.9)], TREE_ROWS),
        "fit_coords": query([*fitted, COORDS], f"SELECT dataset_id, point_id, depth, node_id, component, {num('coord')} AS value FROM coords"),
        "fit_coords_uncentered": query([*fitted, COORDS], f"SELECT dataset_id, point_id, depth, node_id, component, {num('raw')} AS value FROM coords"),
        "node_coords": query([BY_LABEL, *tree(1), COORDS], f"SELECT dataset_id, point_id, depth, node_id, component, {num('coord')} AS value FROM coords WHERE depth = 1"),
        "center_points": query(
            [BY_LABEL, *tree(1)],
            f"""SELECT l.dataset_id, l.node_id, l.point_id, dim, {num('l.v - c.c[dim]')} AS value
  FROM ({long('(SELECT * FROM loc WHERE depth = 1)')}) l JOIN nodes c USING (dataset_id, node_id)""",
        ),
        "node_reconstruct": query(
            [*fitted, COORDS],
            f"""SELECT dataset_id, point_id, depth, node_id, dim, {num('any_value(c) + sum(t)')} AS value FROM (
    SELECT dataset_id, point_id, depth, node_id, unnest(range(1, len(v) + 1)) AS dim, unnest(c) AS c, coord * unnest(v) AS t FROM coords)
  GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY dataset_id, point_id, depth, node_id, dim"),
        ),
        "level_error": query(
            [*fitted, COORDS],
            f"""SELECT dataset_id, depth, count(*) AS n, {num('avg(d2 - on_plane)', 8)} AS mse FROM (
    SELECT dataset_id, depth, point_id, pow(list_distance(any_value(x), any_value(c)), 2) AS d2, sum(coord * coord) AS on_plane FROM coords
    GROUP BY dataset_id, depth, point_id)
  GROUP BY dataset_id, depth""",
        ),
        "level_max": query(fitted, "SELECT dataset_id, depth, max(n) AS max_n FROM nodes GROUP BY ALL"),
        "tree_paths": query(
            fitted,
            """SELECT dataset_id, node_id, depth, parent_id, side, ((1 << depth) - 1)::BIGINT AS level_start, k AS step, ((node_id + 1) >> (depth - k)) - 1 AS ancestor
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes)""",
        ),
        "sibling_cosine": query(fitted, f"SELECT dataset_id, node_id, {num('cosine')} AS split_cosine FROM cosines"),
        "basis_trace": query(fitted, f"SELECT dataset_id, node_id, {num('trace')} AS trace_ab, rank_a::DOUBLE AS trace_aa, rank_b::DOUBLE AS trace_bb FROM cosines"),
        "prune_splits": query([BY_LABEL, *tree(2)], f"SELECT dataset_id, node_id, {num('cosine')} AS split_cosine FROM cosines WHERE coalesce(cosine < 0.5, true)"),
        "project_points": query([*fitted, cloud("walkers", REVERSED), *descent(2)], WALKED_COORDS),
        "project_points_joined": query([*fitted, cloud("walkers", REVERSED), *descent(2)], WALKED_COORDS),
        "leaf_of_point": query([*fitted, cloud("walkers", REVERSED), *descent(2)], "SELECT dataset_id, point_id, max(depth) AS depth, arg_max(node_id, depth) AS node_id FROM walked GROUP BY ALL"),
        "export_vectors": query([*fitted, COORDS], VECTOR_ROWS),
        "model_roundtrip": query([*fitted, COORDS], VECTOR_ROWS),
        "stream_moments": query(
            [BY_LABEL, ROOTS, *planes("r", "roots")],
            f"SELECT dataset_id, n, k AS component, {num('s')} AS singular_value, unnest(range(1, len(v) + 1)) AS dim, unnest(list_transform(c, lambda e: {num('e')})) AS center, unnest(list_transform(v, lambda e: {num('e')})) AS value FROM r_planes",
        ),
        "stream_sketch": query([*labelled, *planes("r", "roots", centered=False)], f"{PLANE_ROWS} FROM r_planes"),
        "stream_project": query([*fitted, cloud("walkers", REVERSED), *descent(2)], WALKED_COORDS),
        "frames_cross_cov": query(rotations(), f"SELECT traj_id, frame_id, i, j, {num('h')} AS value FROM cov"),
        "frames_superpose": query(rotations(), f"SELECT traj_id, frame_id, pos AS atom, axis, {num('v')} AS value FROM turned"),
        "fit_trajectories": query(
            [
                f"""pts AS (SELECT label::VARCHAR AS dataset_id, vec_id AS point_id, list_concat({HARMONIC}, [0.0::DOUBLE, 0.0::DOUBLE]) AS x
  FROM embeddings)""",
                *tree(1),
            ],
            TREE_ROWS,
        ),
        "fit_trajectories_aligned": query(
            [
                *rotations(),
                """pts AS MATERIALIZED (SELECT traj_id AS dataset_id, frame_id AS point_id, list(v ORDER BY pos, axis) AS x
  FROM turned GROUP BY traj_id, frame_id)""",
                *tree(1),
            ],
            TREE_ROWS,
        ),
    }
    out["matrix_multiply_transposed"] = out["matrix_multiply"]
    out["matrix_multiply_rows"] = out["matrix_multiply_chain"]
    return out
