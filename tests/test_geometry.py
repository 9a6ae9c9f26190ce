"""Solvers against planted scenes and dense references."""

import numpy as np
import pytest

from orrery.operators import bundle, focals, rotations, triangulation, two_view
from orrery.operators.state import materialize


def turn(v):
    v = np.asarray(v, float)
    a = np.linalg.norm(v)
    if a < 1e-12:
        return np.eye(3)
    x, y, z = v / a
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def degrees(p, q):
    return np.degrees(np.arccos(np.clip((np.trace(p.T @ q) - 1) / 2, -1, 1)))


# --- relative poses ---


@pytest.fixture(scope="module")
def planted():
    """Pairs with noise of half a thousandth and 40 % wrong matches; the first has far more than a pool, the last too few."""
    r = np.random.default_rng(4)
    rows, truth = [], {}
    for pair, n in enumerate([6000, 400, 300, 250, 200, 200, 150, 7]):
        rot, t = turn(r.normal(size=3) * 0.3), r.normal(size=3)
        t /= np.linalg.norm(t)
        x = r.normal(size=(n, 3)) * 2 + [0, 0, 8]
        y = x @ rot.T + t
        a, b = (p[:, :2] / p[:, 2:] + r.normal(size=(n, 2)) * 2e-4 for p in (x, y))
        wrong = r.random(n) < 0.4
        b[wrong] = r.uniform(-0.6, 0.6, (wrong.sum(), 2))
        rows += [(pair, *map(float, p), *map(float, q)) for p, q in zip(a, b)]
        truth[pair] = rot, t, int((~wrong).sum())
    return rows, truth


def test_relative_poses(spark, planted):
    rows, truth = planted
    df = spark.createDataFrame(rows + [(8, None, 0.0, 0.0, 0.0)], "pair long, x1 double, y1 double, x2 double, y2 double").repartition(6)
    got = {x.pair: x for x in two_view.relative_poses(df, 1e-3).collect()}
    assert set(got) == set(range(7))
    for pair, x in got.items():
        rot, t, good = truth[pair]
        assert degrees(rot, np.array(x.rot).reshape(3, 3)) < 0.5
        assert np.degrees(np.arccos(np.clip(t @ np.array(x.t), -1, 1))) < 2
        assert 0.9 * good < x.n_inliers < 1.15 * good
    again = {x.pair: x.n_inliers for x in two_view.relative_poses(df.repartition(2), 1e-3).collect()}
    assert again == {k: x.n_inliers for k, x in got.items()}


def test_relative_poses_are_exact_without_noise(spark):
    """Wrong matches that happen to lie within the limit don't pull at the matrix."""
    r = np.random.default_rng(9)
    rot, t = turn([0.1, -0.2, 0.05]), np.array([0.6, 0.0, 0.8])
    x = r.normal(size=(4000, 3)) * 2 + [0, 0, 8]
    y = x @ rot.T + t
    a, b = (p[:, :2] / p[:, 2:] for p in (x, y))
    b[:1600] = r.uniform(-0.6, 0.6, (1600, 2))
    df = spark.createDataFrame([(0, *map(float, p), *map(float, q)) for p, q in zip(a, b)], "pair long, x1 double, y1 double, x2 double, y2 double")
    (x,) = two_view.relative_poses(df, 1e-2).collect()
    assert np.abs(np.array(x.rot).reshape(3, 3) - rot).max() < 1e-9
    assert np.abs(np.array(x.t) - t).max() < 1e-9


def test_relative_poses_of_repeated_matches(spark):
    """Right matches that are few but repeated, among wrong ones that are not."""
    r = np.random.default_rng(11)
    rot, t = turn([0.1, -0.2, 0.05]), np.array([0.6, 0.0, 0.8])
    x = r.normal(size=(30, 3)) * 2 + [0, 0, 8]
    y = x @ rot.T + t
    right = np.column_stack([p[:, :2] / p[:, 2:] for p in (x, y)])
    wrong = np.column_stack([r.normal(size=(8000, 2)) * 0.25, r.uniform(-0.6, 0.6, (8000, 2))])
    rows = spark.createDataFrame([(0, *m) for m in np.concatenate([right.repeat(400, 0), wrong]).tolist()], "pair long, x1 double, y1 double, x2 double, y2 double")
    (x,) = two_view.relative_poses(rows, 1e-3).collect()
    assert x.n == 20_000 and x.n_inliers >= 12_000
    assert np.abs(np.array(x.rot).reshape(3, 3) - rot).max() < 1e-9
    assert np.abs(np.array(x.t) - t).max() < 1e-9


def test_candidates_of_a_pool(planted):
    rows, _ = planted
    x = np.array([r[1:] for r in rows if r[0] == 0])
    assert two_view.candidates_of(x[: two_view.POOL], 1e-6, 1).shape == (two_view.CANDIDATES, 3, 3) and two_view.candidates_of(x[:7], 1e-6, 1).shape == (0, 3, 3)


def test_essential_of_exact_matches():
    r = np.random.default_rng(1)
    rot, t = turn([0.1, -0.2, 0.3]), np.array([0.6, 0.0, 0.8])
    x = r.normal(size=(30, 3)) + [0, 0, 5]
    y = x @ rot.T + t
    m = np.column_stack([x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]])
    system = two_view.rows_of(m)
    e = two_view.essential_of((system.T @ system)[None])
    assert two_view.errors(e, m).max() < 1e-18
    assert min(degrees(rot, p) + np.linalg.norm(t - q) for p, q in two_view.poses_of(e[0])) < 1e-5


# --- triangulation ---


def test_triangulation(spark):
    """Exact rays give the planted points by either way, from whole tracks and from merged parts; a track with one ray gives none."""
    r = np.random.default_rng(6)
    points = r.normal(size=(40, 3)) * 3
    rows = []
    for cam in range(12):
        rot = turn(r.normal(size=3) * 0.4)
        pose = np.column_stack([rot, [*r.normal(size=2), 12]])
        for k, p in enumerate(points):
            if (k + cam) % 3 or k == 0:
                q = pose @ [*p, 1]
                rows.append((k, cam, float(q[0] / q[2]), float(q[1] / q[2]), pose.reshape(-1).tolist()))
    rows.append((99, 0, 0.0, 0.0, rows[0][4]))
    rows += [(98, c, 0.1, 0.1, rows[0][4]) for c in range(3)]  # the same ray again fixes no point
    df = spark.createDataFrame(rows, "track_id long, image_id int, x double, y double, pose array<double>")
    parts = triangulation.merged(*[triangulation.normal_sums(df.filter(f"image_id % 3 = {k}")) for k in range(3)])
    for got in (triangulation.triangulate(df), triangulation.triangulate(df, homogeneous=True), triangulation.points_of(parts)):
        found = {x.track_id: x for x in got.collect()}
        assert set(found) == {*range(40), 98} and found[0].n == 12
        assert max(np.abs([found[k].x, found[k].y, found[k].z] - p).max() for k, p in enumerate(points)) < 1e-6
    assert triangulation.triangulate(df).filter("track_id = 98 AND x IS NULL").count() == 1
    plan = triangulation.triangulate(df, homogeneous=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "collect_list" not in plan


def test_weights_pull_a_point(spark):
    eye = np.column_stack([np.eye(3), np.zeros(3)])
    right = np.column_stack([np.eye(3), [-1.0, 0, 0]])
    rows = [(1, 0.0, 0.0, eye, 1.0), (1, -0.5, 0.0, right, 1.0), (1, -0.25, 0.0, right, 1e-6)]
    df = spark.createDataFrame([(k, x, y, p.reshape(-1).tolist(), w) for k, x, y, p, w in rows], "track_id long, x double, y double, pose array<double>, weight double")
    assert abs(triangulation.triangulate(df).first().z - 2) < 1e-3


def test_least_eigenvector(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(50, 4, 4))
    m = m @ m.transpose(0, 2, 1)
    m[0], m[1] = np.diag([3.0, 1, 2, 5]), np.eye(4)
    df = spark.createDataFrame([(k, x.reshape(-1).tolist()) for k, x in enumerate(m)], "k int, m array<double>")
    for x in df.select("k", triangulation.least_eigenvector(df.m).alias("v")).collect():
        v = np.array(x.v)
        assert abs(np.linalg.norm(v) - 1) < 1e-9
        assert abs(v @ m[x.k] @ v - np.linalg.eigvalsh(m[x.k])[0]) < 1e-8


# --- rotation averaging ---


def test_rotation_averaging(spark):
    """A sparse graph with a tenth of a degree of noise and a fifth of wrong edges: all nodes within half a degree. SOL04's query has exact edges."""
    r = np.random.default_rng(9)
    n, rows = 25, []
    planted = [turn(r.normal(size=3)) for _ in range(n)]
    for a in range(n):
        for b in sorted({*[(a + k) % n for k in (1, 2, 3)], *r.integers(0, n, 3).tolist()} - {a}):
            rot = turn(r.normal(size=3) * 0.002) @ planted[b] @ planted[a].T
            if r.random() < 0.2:
                rot = turn(r.normal(size=3)) @ rot
            rows.append((a, b, float(r.integers(1, 9)), rot.reshape(-1).tolist()))
    rows.append((4, 4, 1.0, np.eye(3).reshape(-1).tolist()))
    df = spark.createDataFrame(rows, "a long, b long, w double, rot array<double>")
    got = {x.node: np.array(x.rot).reshape(3, 3) for x in rotations.average(df, 0).collect()}
    assert set(got) == set(range(n)) and np.allclose(got[0], np.eye(3))
    assert max(degrees(got[k], planted[k] @ planted[0].T) for k in range(n)) < 0.5


def test_conjugate_gradients_solve_the_laplacian(spark):
    r = np.random.default_rng(2)
    n, rows = 12, []
    for a in range(n):
        for b in {(a + 1) % n, int(r.integers(n))} - {a}:
            rows.append((a, b, float(r.uniform(0.5, 2)), *map(float, r.normal(size=3))))
    lap, rhs = np.zeros((n, n)), np.zeros((n, 3))
    for a, b, w, *o in rows:
        lap[a, a] += w
        lap[b, b] += w
        lap[a, b] -= w
        lap[b, a] -= w
        rhs[b] += w * np.array(o)
        rhs[a] -= w * np.array(o)
    want = np.linalg.lstsq(lap, rhs, rcond=None)[0]
    kept, rotations.ENOUGH = rotations.ENOUGH, 1e-20
    try:
        got = {x.node: [x.x0, x.x1, x.x2] for x in rotations.solved(spark.createDataFrame(rows, "a long, b long, weight double, o0 double, o1 double, o2 double")).collect()}
    finally:
        rotations.ENOUGH = kept
    x = np.array([got[k] for k in range(n)])
    assert np.abs((x - x.mean(0)) - (want - want.mean(0))).max() < 1e-8


# --- bundles ---


def scene(r, n_cameras=5, n_points=30):
    poses = [(turn(r.normal(size=3) * 0.2), np.array([*r.normal(size=2), 8.0])) for _ in range(n_cameras)]
    points = r.normal(size=(n_points, 3)) * 1.5
    seen = [(i, k) for i in range(n_cameras) for k in range(n_points) if (i + k) % 4]
    at = np.array([poses[i][0] @ points[k] + poses[i][1] for i, k in seen])
    return poses, points, seen, at[:, :2] / at[:, 2:]


def frames_of(spark, poses, points, seen, xy):
    obs = spark.createDataFrame([(i, k, float(x), float(y)) for (i, k), (x, y) in zip(seen, xy)], "camera long, track long, x double, y double").repartition(3)
    cams = spark.createDataFrame([(i, rot.reshape(-1).tolist(), t.tolist()) for i, (rot, t) in enumerate(poses)], "camera long, rot array<double>, t array<double>")
    return obs, cams, spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "track long, p array<double>")


def test_blocks_are_derivatives():
    r = np.random.default_rng(5)
    rot, t, p, xy = turn([0.3, -0.2, 0.5]), np.array([0.2, 0.1, 6.0]), r.normal(size=3), np.array([0.01, 0.02])
    cost = lambda d: float(bundle.blocks_of((turn(d[:3]) @ rot)[None], (t + d[3:6])[None], (p + d[6:])[None], xy[None], 10.0)[5][0])
    w, u, v, gc, gp, _ = bundle.blocks_of(rot[None], t[None], p[None], xy[None], 10.0)
    # turning acts before the shift, as in moved
    eps, want = 1e-6, np.concatenate([gc[0], gp[0]])
    got = [(cost(eps * e) - cost(-eps * e)) / (2 * eps) for e in np.eye(9)]
    assert np.allclose(got, want, atol=1e-7)
    assert bundle.blocks_of(rot[None], (t - [0, 0, 20])[None], p[None], xy[None], 0.5)[5][0] == 0.5


def test_a_bundle_step_equals_a_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(bundle, "ENOUGH", 1e-22)
    monkeypatch.setattr(bundle, "CG_STEPS", 40)
    r = np.random.default_rng(7)
    poses, points, seen, xy = scene(r, 3, 12)
    poses = [(turn(r.normal(size=3) * 0.02) @ rot, t + r.normal(size=3) * 0.05) for rot, t in poses]
    points = points + r.normal(size=points.shape) * 0.05
    obs, cams, pts = frames_of(spark, poses, points, seen, xy)
    i, k = np.array([x for x, _ in seen]), np.array([x for _, x in seen])
    w, u, v, gc, gp, _ = bundle.blocks_of(np.array([poses[x][0] for x in i]), np.array([poses[x][1] for x in i]), points[k], xy, 0.05)
    n, m = len(poses), len(points)
    h, g = np.zeros((6 * n + 3 * m,) * 2), np.zeros(6 * n + 3 * m)
    for j in range(len(seen)):
        a, b = slice(6 * i[j], 6 * i[j] + 6), slice(6 * n + 3 * k[j], 6 * n + 3 * k[j] + 3)
        h[a, a] += u[j]
        h[b, b] += v[j]
        h[a, b] += w[j]
        h[b, a] += w[j].T
        g[a] += gc[j]
        g[b] += gp[j]
    h += np.diag(np.diag(h)) * 0.01 + 1e-12 * np.eye(len(h))
    want = np.linalg.solve(h, -g)
    lin = materialize(bundle.linearised(obs, cams, pts, 0.05))
    cameras, tracks = bundle.steps(lin, 0.01)
    x = np.array([c.x for c in cameras.orderBy("camera").collect()])
    d = np.array([c.d for c in tracks.orderBy("track").collect()])
    assert np.abs(x.reshape(-1) - want[: 6 * n]).max() < 1e-7 and np.abs(d.reshape(-1) - want[6 * n :]).max() < 1e-7


def test_bundle_adjustment_lowers_the_cost(spark):
    r = np.random.default_rng(11)
    poses, points, seen, xy = scene(r)
    wrong = r.random(len(seen)) < 0.03
    xy = xy + wrong[:, None] * 0.3
    near = [(turn(r.normal(size=3) * 0.03) @ rot, t + r.normal(size=3) * 0.1) for rot, t in poses]
    obs, cams, pts = frames_of(spark, near, points + r.normal(size=points.shape) * 0.1, seen, xy)
    cameras, tracks, costs = bundle.adjust(obs, cams, pts, rounds=2, huber=0.02)
    i, k = np.array([x for x, _ in seen]), np.array([x for _, x in seen])
    least = bundle.blocks_of(np.array([poses[x][0] for x in i]), np.array([poses[x][1] for x in i]), points[k], xy, 0.02)[5].sum()
    assert len(costs) == 3 and all(b < a for a, b in zip(costs, costs[1:])) and costs[-1] - least < 0.05 * (costs[0] - least)
    rows = {x.camera: x for x in cameras.collect()}
    assert all(np.allclose(np.array(x.rot).reshape(3, 3) @ np.array(x.rot).reshape(3, 3).T, np.eye(3)) for x in rows.values()) and tracks.count() == len(points)


def test_bundles_of_few_cameras_move_observations_once(spark, monkeypatch):
    """Few cameras: a step is that of a dense solver, also with a view seen twice and one of an unknown camera, and nothing but tracks is written."""
    r = np.random.default_rng(17)
    poses, points, seen, xy = scene(r, 4, 20)
    seen, xy = [*seen, seen[3]], np.concatenate([xy, xy[3:4] + 0.01])
    poses = [(turn(r.normal(size=3) * 0.02) @ rot, t + r.normal(size=3) * 0.05) for rot, t in poses]
    points = points + r.normal(size=points.shape) * 0.05
    obs, cams, pts = frames_of(spark, poses, points, [*seen, (99, 1)], np.concatenate([xy, xy[:1]]))
    i, k = np.array(seen).T
    w, u, v, gc, gp, cost = bundle.blocks_of(np.array([poses[x][0] for x in i]), np.array([poses[x][1] for x in i]), points[k], xy, 0.5)
    n, m = len(poses), len(points)
    h, g = np.zeros((6 * n + 3 * m,) * 2), np.zeros(6 * n + 3 * m)
    for j in range(len(seen)):
        a, b = np.arange(6) + 6 * i[j], np.arange(3) + 6 * n + 3 * k[j]
        h[np.ix_(a, a)] += u[j]
        h[np.ix_(b, b)] += v[j]
        h[np.ix_(a, b)] += w[j]
        h[np.ix_(b, a)] += w[j].T
        g[a] += gc[j]
        g[b] += gp[j]
    h += np.diag(np.diag(h)) * 0.01 + 1e-12 * np.eye(len(h))
    want = np.linalg.solve(h, -g)
    written, keep = [], bundle.materialize
    monkeypatch.setattr(bundle, "materialize", lambda df, what="state": written.append(what) or keep(df, what))
    cameras, tracks, costs = bundle.adjust(obs, cams, pts, rounds=1, huber=0.5, damping=0.01)
    assert set(written) == {"tracks"} and np.isclose(costs[0], cost.sum()) and costs[1] < costs[0]
    x = want[: 6 * n].reshape(n, 6)
    for row in cameras.collect():
        rot, t = poses[row.camera]
        assert np.allclose(np.array(row.rot).reshape(3, 3), turn(x[row.camera, :3]) @ rot, atol=1e-7) and np.allclose(row.t, t + x[row.camera, 3:], atol=1e-7)
    assert np.allclose([row.p for row in tracks.orderBy("track").collect()], points + want[6 * n :].reshape(m, 3), atol=1e-7)


# --- focal lengths ---


def test_focal_calibration(spark):
    """Noise on the matrices and an eighth of wrong ones: all focal lengths within one percent; a camera without an edge keeps its prior."""
    r = np.random.default_rng(13)
    n = 14
    planted = r.uniform(400, 900, n)
    poses = [(turn(r.normal(size=3) * 0.6), r.normal(size=3) * 3) for _ in range(n)]
    rows = []
    for a in range(n):
        for b in range(a + 1, n):
            rot = poses[b][0] @ poses[a][0].T
            x, y, z = poses[b][0] @ (poses[a][1] - poses[b][1])
            e = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]) @ rot
            f = np.diag([1 / planted[b], 1 / planted[b], 1]) @ e @ np.diag([1 / planted[a], 1 / planted[a], 1])
            f = f * (1 + r.normal(size=(3, 3)) * 5e-4)
            if r.random() < 0.125:
                f = f.T * r.uniform(0.5, 1.5, (3, 3))
            rows.append((a, b, f.reshape(-1).tolist()))
    cams = [(k, float(planted[k] * r.uniform(0.8, 1.25))) for k in range(n)] + [(99, 640.0)]
    got = {x.camera: x for x in focals.calibrate(spark.createDataFrame(rows, "a long, b long, f array<double>"), spark.createDataFrame(cams, "camera long, focal double")).collect()}
    assert max(abs(got[k].focal / planted[k] - 1) for k in range(n)) < 0.01
    assert got[99].focal == got[99].prior == 640.0 and got[99].error is None


def test_pairs_of_focal_lengths_are_made_once(spark, monkeypatch):
    from conftest import DATA

    from orrery.plans import geometry

    class Seen(Exception):
        pass

    def look(pairs, cameras):
        raise Seen(pairs.inputFiles()[0])

    monkeypatch.setattr(geometry.focals, "calibrate", look)
    with pytest.raises(Seen, match="orrery-pairs"):
        geometry.sol01_focals(spark, DATA)
