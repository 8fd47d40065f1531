import math

import numpy as np
import pytest

from fieldloom.operators import bases as B
from fieldloom.operators import trajectories as T
from fieldloom.operators.incremental import IncrementalModes, triangle
from fieldloom.plans import facade


def blobs(spark, rng, n=40):
    at = np.array([[0, 0], [10, 0], [0, 12.0]])
    rows = [(s, t, *(at[(t // n + s) % 3] + rng.normal(0, 0.4, 2)).tolist()) for s in range(3) for t in range(3 * n)]
    return rows, spark.createDataFrame(rows, "s int, t int, u double, v double")


def test_trajectory_clusters_match_lloyd(spark):
    rng = np.random.default_rng(0)
    rows, df = blobs(spark, rng)
    start = [(1.0, 1.0), (8.0, 1.0), (5.0, 5.0)]
    found = facade.run("trajectory_clustering", df, "s", "t", ["u", "v"], 7, 3, centers=start)
    x = {(s, i): np.mean([[r[2], r[3]] for r in rows if r[0] == s and i <= r[1] < i + 7], axis=0) for s in range(3) for i in range(114)}
    points, c = np.array(list(x.values())), np.array(start)
    for _ in range(100):
        label = ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([points[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(3)])
    got = {(r.s, r.start): r for r in found.labels.collect()}
    assert {k: r.label for k, r in got.items()} == dict(zip(x, label.tolist()))
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    for i, k in enumerate(x):
        own = label == label[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
        assert got[k].silhouette == pytest.approx((b - a) / max(a, b))
    assert found.silhouette.first()[0] == pytest.approx(np.mean([r.silhouette for r in got.values()]))
    for r in found.centers.collect():
        assert (r.u, r.v) == pytest.approx(c[r.label]) and r.n == (label == r.label).sum()
    for s in range(3):
        runs = [r for r in found.runs.orderBy("start").collect() if r.s == s]
        assert [r.label for r in runs for _ in range(r.start, r.end)] == [got[s, i].label for i in range(114)]
        assert all(a.label != b.label and a.end == b.start for a, b in zip(runs, runs[1:]))


def test_sampled_seeds_find_groups_and_do_not_depend_on_partitions(spark):
    _, df = blobs(spark, np.random.default_rng(1))
    centers = T.seed_centers(df, ["s", "t"], ["u", "v"], 3, seed=4)
    assert centers == T.seed_centers(df.repartition(7), ["s", "t"], ["u", "v"], 3, seed=4)
    found = T.trajectory_clustering(df, "s", "t", ["u", "v"], 1, 3)
    assert found.silhouette.first()[0] > 0.95
    assert sorted((round(r.u), round(r.v)) for r in found.centers.collect()) == [(0, 0), (0, 12), (10, 0)]


def test_few_or_no_windows(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, None)], "s string, t int, u double")
    one = T.trajectory_clustering(df, "s", "t", ["u"], 2, 3)
    assert [tuple(r) for r in one.labels.select("s", "start", "u", "label", "silhouette").collect()] == [("a", 0, 2.0, 0, 0.0)]
    none = T.trajectory_clustering(df, "s", "t", ["u"], 5, 2)
    assert none.labels.count() == none.centers.count() == none.runs.count() == 0
    with pytest.raises(ValueError):
        T.trajectory_clustering(df, "s", "t", ["u"], 0, 2)


def long(spark, x, first=0):
    return spark.createDataFrame([(first + j, i, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "snap int, at int, x double")


def grown(spark, x, cuts, **options):
    state, at = IncrementalModes(**options), 0
    for n in cuts:
        state = state.update(long(spark, x[:, at : at + n], at), "snap", "at", "x")
        at += n
    return state


@pytest.mark.parametrize("cuts", [[9], [1, 3, 5], [4, 5]])
@pytest.mark.parametrize("center", ["exact", "running", None])
def test_batches_give_the_singular_values_of_all_snapshots(spark, cuts, center):
    x = np.random.default_rng(2).normal(size=(30, 9)) + np.arange(30)[:, None]
    mean = {"exact": x.mean(axis=1, keepdims=True), "running": np.cumsum(x, axis=1) / np.arange(1, 10), None: 0.0}[center]
    u, s, _ = np.linalg.svd(x - mean, full_matrices=False)
    state = grown(spark, x, cuts, n_modes=20, center=center)
    r = (s > 1e-9).sum()
    assert state.n == 9 and state.sigma == pytest.approx(s[:r]) and state.energy().sum() == pytest.approx(1)
    got = np.zeros((r, 30))
    for m, i, phi in state.modes().select("mode", "point", "phi").collect():
        got[m, i] = phi
    assert np.abs(got @ u[:, :r]) == pytest.approx(np.eye(r), abs=1e-6)
    a = np.zeros((9, r))
    for j, m, v in state.project(long(spark, x), "snap", "at", "x").collect():
        a[j, m] = v
    shown = x.T - (0 if center is None else x.mean(axis=1))
    assert a == pytest.approx(shown @ got.T, abs=1e-6)


def test_forgetting_and_truncation(spark):
    x = np.random.default_rng(3).normal(size=(40, 6))
    y = (x - np.cumsum(x, axis=1) / np.arange(1, 7)) * 0.7 ** np.arange(5, -1, -1)
    state = grown(spark, x, [2, 1, 3], n_modes=20, forget=0.7)
    assert state.sigma == pytest.approx(np.linalg.svd(y, compute_uv=False)[:5])
    few = grown(spark, x, [6], n_modes=2, forget=0.7)
    assert few.sigma == pytest.approx(state.sigma[:2])


def test_states_merge(spark):
    x = np.random.default_rng(4).normal(size=(25, 8)) + 3
    parts = []
    for a, b in ((0, 3), (3, 8)):
        parts.append(IncrementalModes(n_modes=20, center="exact").update(long(spark, x[:, a:b], a), "snap", "at", "x"))
    both = parts[0].merge(parts[1])
    s = np.linalg.svd(x - x.mean(axis=1, keepdims=True), compute_uv=False)
    assert both.n == 8 and both.sigma == pytest.approx(s[:7])
    assert {r.point: r.mean for r in both.table.collect()} == pytest.approx(dict(enumerate(x.mean(axis=1))))
    assert IncrementalModes(center="exact").merge(parts[0]) is parts[0]
    with pytest.raises(ValueError):
        grown(spark, x, [8]).merge(grown(spark, x, [8]))


def test_triangles_merge_in_a_tree(spark):
    x = np.random.default_rng(5).normal(size=(700, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "b array<double>").repartition(40)
    r = triangle(df, "b")
    assert r.T @ r == pytest.approx(x.T @ x)


def table(spark, bases, params):
    return spark.createDataFrame([(float(p), m, i, float(y[i, m])) for p, y in zip(params, bases) for m in range(y.shape[1]) for i in range(y.shape[0])], "param double, mode int, point int, phi double")


def dense(spark_table, n, r):
    y = np.zeros((n, r))
    for m, i, v in spark_table.select("mode", "point", "phi").collect():
        y[i, m] = v
    return y


def geodesic(y0, y1, t, steepest=1.0):
    m = (y1 - y0 @ (y0.T @ y1)) @ np.linalg.inv(y0.T @ y1)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    a = np.arctan(np.minimum(s, steepest)) * t
    return y0 @ vt.T @ np.diag(np.cos(a)) @ vt + u @ np.diag(np.sin(a)) @ vt


@pytest.mark.parametrize("spread, steepest", [(0.1, 1.0), (0.8, 1.0), (0.8, None)])
def test_bases_interpolate_along_the_geodesic(spark, spread, steepest):
    rng = np.random.default_rng(6)
    first = rng.normal(size=(20, 3))
    bases = [np.linalg.qr(first + spread * k * rng.normal(size=(20, 3)))[0] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for k in range(4)]
    params = [0.0, 1.0, 1.5, 4.0]
    df = table(spark, bases, params)

    def near(i):
        u, _, vt = np.linalg.svd(bases[0].T @ bases[i])
        return bases[i] @ vt.T @ u.T

    found, distances = facade.run("basis_interpolate", df, 1.2, steepest=steepest)
    want = geodesic(near(1), near(2), 0.4, steepest or np.inf)
    got = dense(found, 20, 3)
    assert got.T @ got == pytest.approx(np.eye(3), abs=1e-9)
    assert got @ got.T == pytest.approx(want @ np.linalg.inv(want.T @ want) @ want.T, abs=1e-8)
    assert (np.diag(got.T @ want) > 0).all()
    for t, i in ((-1, 0), (0, 0), (4, 3), (9, 3)):
        assert dense(B.basis_interpolate(df, t)[0], 20, 3) == pytest.approx(near(i), abs=1e-9)
    sines = [math.sqrt(max(0, 3 - (np.linalg.norm(a.T @ b) ** 2))) for a, b in zip(bases, bases[1:])]
    assert distances == pytest.approx(sines)


def test_bases_that_differ_or_are_too_few(spark):
    y = np.linalg.qr(np.random.default_rng(7).normal(size=(6, 2)))[0]
    with pytest.raises(ValueError):
        B.basis_interpolate(table(spark, [y], [0.0]), 0.5)
    with pytest.raises(ValueError):
        B.basis_interpolate(table(spark, [y, y[:, :1]], [0.0, 1.0]), 0.5)
    same = dense(B.basis_interpolate(table(spark, [y, y], [0.0, 1.0]), 0.5)[0], 6, 2)
    assert same == pytest.approx(y)
