import numpy as np
import pytest

from fieldloom.operators import surfaces as S


def to_segment(p, a, b):
    t = np.clip(np.dot(p - a, b - a) / max(np.dot(b - a, b - a), 1e-300), 0, 1)
    return np.linalg.norm(p - a - t * (b - a))


def to_triangle(p, t):
    a, b, c = t.reshape(3, 3)
    n = np.cross(b - a, c - a)
    best = min(to_segment(p, a, b), to_segment(p, b, c), to_segment(p, c, a))
    if n @ n > 0:
        q = p - (p - a) @ n / (n @ n) * n
        if all(np.cross(v - u, q - u) @ n > 0 for u, v in ((a, b), (b, c), (c, a))):
            best = min(best, np.linalg.norm(p - q))
    return best


def frames(spark, points, triangles):
    p = spark.createDataFrame([(i, *map(float, x), "v") for i, x in enumerate(points)], "pid long, x double, y double, z double, level string")
    t = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(triangles)], "tri long, " + ", ".join(f"{c} double" for c in S.CORNERS))
    return p, t


@pytest.mark.parametrize("cell", [0.3, 5.0, 200.0])
def test_distances_match_brute_force(spark, cell):
    rng = np.random.default_rng(0)
    corner = rng.normal(size=(40, 3)) * 10
    triangles = np.hstack([corner, corner + rng.normal(size=(40, 3)), corner + rng.normal(size=(40, 3))])
    triangles = np.vstack([triangles, [[-500, 0, 0, 500, 0, 0, 0, 900, 1]], [[3, 3, 3] * 3], [[0, 0, 5, 1, 1, 5, 2, 2, 5]]])
    points = np.vstack([rng.normal(size=(60, 3)) * 12, corner[:5], [[0, 0, 0], [1, 300, 70], [400, -400, 90]]])
    got = {r.pid: r for r in S.nearest_triangle(*frames(spark, points, triangles), "pid", "tri", cell).collect()}
    for i, p in enumerate(points):
        want = [to_triangle(p, t) for t in triangles]
        assert got[i].distance == pytest.approx(min(want), abs=1e-9)
        assert want[got[i].tri] == pytest.approx(min(want), abs=1e-9)
        assert np.linalg.norm(p - [got[i].x, got[i].y, got[i].z]) == pytest.approx(got[i].distance, abs=1e-9)
    # A point beside a large triangle has its plane's distance, not that to a corner.
    assert got[66].kind == "face" and got[66].distance < 71


def box():
    """A closed unit cube of twelve triangles with outward normals."""
    v = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return np.array([np.concatenate([v[a], v[b], v[c]]) for q in quads for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))])


def test_signs_of_a_closed_surface(spark):
    points = np.random.default_rng(1).uniform(-0.5, 1.5, size=(300, 3))
    p, t = frames(spark, points, box())
    assert S.is_closed(t, "tri") and not S.is_closed(t.filter("tri > 0"), "tri") and not S.is_closed(t.limit(0), "tri")
    found = S.attach_wall_features(p, t, "pid", "tri", 0.2)
    assert found.columns == [*p.columns, "wall_distance", "wall_sdf"]
    inside = ((points > 0) & (points < 1)).all(axis=1)
    depth = np.minimum(points, 1 - points).min(axis=1)
    outside = np.linalg.norm(points - points.clip(0, 1), axis=1)
    got = {r.pid: r for r in found.collect()}
    for i in range(300):
        want = -depth[i] if inside[i] else outside[i]
        assert got[i].wall_sdf == pytest.approx(want, abs=1e-9) and got[i].wall_distance == pytest.approx(abs(want), abs=1e-9)
    assert S.attach_wall_features(p, t.filter("tri > 0"), "pid", "tri", 0.2, "w").columns == [*p.columns, "w_distance"]


def test_missing_coordinates_and_surfaces(spark):
    p, t = frames(spark, [[0, 0, 0], [1, 1, 1]], box())
    p = p.unionByName(spark.createDataFrame([(7, None, 0.0, 0.0, "v"), (8, float("inf"), 0.0, 0.0, "v")], p.schema))
    got = {r.pid: r.wall_distance for r in S.attach_wall_features(p, t, "pid", "tri", 1.0).collect()}
    assert got == {0: 0.0, 1: 0.0, 7: None, 8: None}
    assert {r.wall_distance for r in S.attach_wall_features(p, t.limit(0), "pid", "tri", 1.0).collect()} == {None}
    assert S.attach_wall_features(p.limit(0), t, "pid", "tri", 1.0).collect() == []


def test_cells_are_halved_until_a_place_meets_few_triangles(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 10)
    monkeypatch.setattr(S, "PAIRS_OF_CELL", 500)
    monkeypatch.setattr(S, "PAIRS_OF_PLACE", 60)
    met = spark.sparkContext.accumulator(0)
    closest = S._closest

    def counted(rows, at):
        met.add(rows.num_rows if tuple(at) == S.PLACE else 0)
        return closest(rows, at)

    monkeypatch.setattr(S, "_closest", counted)
    rng = np.random.default_rng(3)
    corner = rng.uniform(0, 20, size=(300, 3))
    triangles = np.hstack([corner, corner + rng.normal(size=(300, 3)) * 6, corner + rng.normal(size=(300, 3)) * 6])
    triangles = np.vstack([triangles, triangles[:20]])  # equals: the smaller id counts
    points = np.vstack([np.round(rng.uniform(0, 20, size=(300, 3)), 1), [[900, -900, 30], [0, 0, 0]]])
    p, t = frames(spark, np.vstack([points, points]), triangles)
    got = {r.pid: r for r in S.nearest_triangle(p, t, "pid", "tri", 2.0).collect()}
    assert len(got) == 604
    for i, at in enumerate(points):
        want = [to_triangle(at, x) for x in triangles[:300]]
        for r in (got[i], got[i + 302]):
            assert r.distance == pytest.approx(min(want), abs=1e-9)
            assert r.tri < 300 and want[r.tri] == pytest.approx(min(want), abs=1e-9)
    assert met.value <= 60 * 302  # all pairs: 300 * 302
