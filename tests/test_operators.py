import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import expression, scalars
from fieldloom.operators import aggregates as A
from fieldloom.operators import diagnostics as X
from fieldloom.operators import joins as J
from fieldloom.operators import morphology as M
from fieldloom.operators import recursions as R
from fieldloom.operators import relations as S
from fieldloom.operators import rom
from fieldloom.operators import sampling as D
from fieldloom.operators import series as T
from fieldloom.plans import facade


@pytest.fixture(scope="module")
def wave(spark):
    x = np.sin(2 * np.pi * 0.125 * np.arange(256)) + np.where(np.arange(256) >= 128, 3.0, 0.0)
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, -2.0), (4.0, 0.0), (9.0, 3.0)], "a double, b double")
    ev = lambda e: [r.result for r in expression.safe_eval(df, e).collect()]
    assert ev("sqrt(a) + b") == [-1.0, 2.0, 6.0]
    assert ev("a if b < 0 else -a") == [1.0, -4.0, -9.0]
    assert ev("1 <= a < 9 and not (b == 0)") == [True, False, False]
    assert ev("a / b")[1] == math.inf and math.isnan(ev("b / (b * 0)")[1])
    assert ev("a - mean(a)") == pytest.approx([1 - 14 / 3, 4 - 14 / 3, 9 - 14 / 3])
    assert ev("b % 3") == [1.0, 0.0, 0.0] and ev("-7 // 2") == [-4.0] * 3
    for bad in ("__import__('os')", "a.x", "zz", "a +", "sum(a - mean(a))", "'s'", "sqrt(a, b)"):
        with pytest.raises(expression.ExpressionError):
            expression.safe_eval(df, bad)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.convert(F.lit(100.0), "C", "K")) == pytest.approx(373.15)
    with pytest.raises(ValueError):
        scalars.convert(F.lit(1.0), "Pa", "K")
    for z in (-3.0, -0.5, 0.0, 1.3):
        assert one(scalars.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / 2**0.5)), abs=2e-7)
    assert one(scalars.morton3(F.lit(5), F.lit(3), F.lit(1))) == sum(((v >> b) & 1) << (3 * b + k) for k, v in enumerate((5, 3, 1)) for b in range(21))
    df = spark.createDataFrame([([1.0, 2.0, 3.0], ["a", "b"])], "v array<double>, m array<string>")
    assert sum(df.select(scalars.softmax("v")).first()[0]) == pytest.approx(1)
    assert len(df.select(scalars.hash_chain("m")).first()[0]) == 2


def test_spectrum_changes_and_search(wave):
    psd = R.welch(wave.filter("i < 128"), "k", "i", "x", 1.0, 64).toPandas()
    assert psd.loc[psd.psd.idxmax(), "frequency"] == 0.125
    assert [r.change for r in R.partition_changes(wave, "k", "i", "x").collect()] == [128]
    q = [float(v) for v in np.sin(2 * np.pi * 0.125 * np.arange(16))]
    best = R.motif_profile(wave, "k", "i", "x", q).orderBy("distance", "i").first()
    assert best.distance < 1e-3 and best.i % 8 == 0
    assert R.first_alarm(wave, "k", "i", "x", 8.0).first().first_alarm >= 128


def test_gate_and_rls(spark):
    df = spark.createDataFrame([("s", t) for t in (0.0, 0.5, 1.0, 1.0, 2.5, 3.0)], "k string, t double")
    assert [r.t for r in R.spaced(df, "k", "t", 1.0).orderBy("t").collect()] == [0.0, 1.0, 2.5]
    rng = np.random.default_rng(0)
    rows = [("s", i, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    w = R.recursive_least_squares(spark.createDataFrame(rows, "k string, i int, a double, b double, y double"), "k", "i", ["a", "b"], "y", 1.0, 1e6)
    assert w.orderBy(F.desc("i")).first().weights == pytest.approx([2, -1], abs=1e-3)


def test_pod_matches_svd(spark):
    x = np.random.default_rng(3).normal(size=(40, 6)) @ np.diag([9, 5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(s, p, float(x[p, s])) for p in range(40) for s in range(6)], "s int, p int, v double")
    m = rom.pod(df, "s", "p", "v")
    u, sigma, _ = np.linalg.svd(x, full_matrices=False)
    assert m.sigma == pytest.approx(sigma, rel=1e-6)
    phi = rom.spatial_modes(df, m, "s", "p", "v", 3)
    got = phi.toPandas().pivot(index="p", columns="mode", values="phi").to_numpy()
    assert np.abs(got.T @ u[:, :3]) == pytest.approx(np.eye(3), abs=1e-6)
    err = {r.s: r.residual for r in rom.reconstruction_error(df, phi, "s", "p", "v").collect()}
    assert [err[s] for s in range(6)] == pytest.approx(np.linalg.norm(x - u[:, :3] @ u[:, :3].T @ x, axis=0), abs=1e-6)
    with pytest.raises(ValueError):
        rom.gram(df, "p", "s", "v", at_most=10)


def test_regression_and_mahalanobis(spark):
    x = np.random.default_rng(1).normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(3 * a - 2 * b + 1)) for a, b in x], "a double, b double, y double")
    assert rom.ridge_regression(df, ["a", "b"], "y") == pytest.approx([3, -2, 1])
    z = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ni,ij,nj->n", z, np.linalg.inv(np.cov(x.T) + 1e-12 * np.eye(2)), z))
    assert sorted(r.score for r in rom.mahalanobis(df, ["a", "b"]).collect()) == pytest.approx(sorted(want))


def test_pareto_and_triangles(spark):
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.random.default_rng(2).integers(0, 12, (80, 2)))]
    df = spark.createDataFrame(pts, "i int, f double, g double").repartition(5)
    want = {i for i, a, b in pts if not any(c <= a and d <= b and (c < a or d < b) for _, c, d in pts)}
    assert {r.i for r in J.pareto(df, ["f", "g"]).collect()} == want
    tri = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0), (1, 4.0, 4.0, 0.0, 4.0, 4.0, 0.0)], "tri int, ax double, ay double, bx double, by double, cx double, cy double")
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.0), (2, 2.0, 2.0), (3, 9.0, 9.0)], "pid int, x double, y double")
    assert {r.pid: r.tri for r in J.locate_triangles(p, tri, "pid", "tri", 1.0).collect()} == {0: 0, 1: 1, 2: 0, 3: -1}


def _labels(mask, connectivity):
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 2 or not (a and b))]
    want, n = np.zeros(mask.shape, int), 0
    for i, j in zip(*np.nonzero(mask)):
        if not want[i, j]:
            n, todo = n + 1, [(i, j)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + da, b + db) for da, db in steps]
    return want


@pytest.mark.parametrize(("connectivity", "tile"), [(1, 4), (2, 3), (1, 1024)])
def test_components(spark, connectivity, tile):
    mask = np.random.default_rng(4).random((9, 11)) < 0.45
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(mask))], "i int, j int")
    want = _labels(mask, connectivity)
    got = {(r.i, r.j): (r.label, r.size) for r in M.components(df, "i", "j", mask.shape, connectivity=connectivity, tile=tile).collect()}
    assert got == {(i, j): (want[i, j], (want == want[i, j]).sum()) for i, j in zip(*np.nonzero(mask))}
    assert M.components(df.limit(0), "i", "j", mask.shape).count() == 0


@pytest.mark.parametrize("connectivity", [1, 2])
def test_dilation_and_erosion(spark, connectivity):
    mask = np.random.default_rng(5).random((8, 7)) < 0.6
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(mask))], "i int, j int")
    near = lambda i, j: [(a, b) for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) if connectivity == 2 or a == i or b == j]
    inside = lambda a, b: 0 <= a < 8 and 0 <= b < 7
    cells = [(i, j) for i in range(8) for j in range(7)]
    rows = lambda d: {(r.i, r.j) for r in d.collect()}
    assert rows(M.dilate(df, "i", "j", (8, 7), connectivity=connectivity)) == {c for c in cells if any(inside(*x) and mask[x] for x in near(*c))}
    assert rows(M.erode(df, "i", "j", connectivity=connectivity)) == {c for c in cells if all(inside(*x) and mask[x] for x in near(*c))}


def test_fewer_points_than_neighbours(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0)], "p int, x double, y double")
    targets = spark.createDataFrame([(7, 0.1, 0.0), (8, 5e5, 5.0)], "t int, x double, y double")
    got = {(r.t, r.p) for r in J.knn(points, targets, "p", "t", ["x", "y"], 5, 1.0).collect()}
    assert got == {(7, 1), (7, 2), (8, 1), (8, 2)}
    assert J.knn(points.limit(0), targets, "p", "t", ["x", "y"], 5, 1.0).count() == 0


def test_neighbours_among_copies_and_dense_points(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.integers(0, 4, (300, 2)) * 1.0, rng.random((300, 2)) / 100, rng.random((20, 2)) * 50])
    targets = np.concatenate([xy[::9], rng.random((30, 2)) * 60, rng.random((5, 2)) / 100])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "p int, x double, y double")
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([targets, targets[:20]]))], "t int, x double, y double")
    got = {(r.t, r.rank): r.p for r in J.knn(p, t, "p", "t", ["x", "y"], 4, 8.0).collect()}
    for i, at in enumerate(np.concatenate([targets, targets[:20]])):
        d = np.sqrt(((xy - at) ** 2).sum(axis=1))
        assert [got[i, n + 1] for n in range(4)] == np.lexsort((np.arange(len(xy)), d))[:4].tolist()


def test_neighbours_give_their_mean(spark):
    rng = np.random.default_rng(5)
    xy, at = np.concatenate([rng.random((200, 2)) * 9, np.ones((5, 2))]), np.concatenate([rng.random((20, 2)) * 9, np.ones((2, 2))])
    v = rng.random(len(xy))
    p = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(xy, v))], "p int, x double, y double, v double")
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "t int, x double, y double")
    got = {r.t: r.value for r in J.knn_mean(p, t, "p", "t", ["x", "y"], "v", 4, 2.0).collect()}
    near = [np.lexsort((np.arange(len(xy)), np.sqrt(((xy - a) ** 2).sum(axis=1))))[:4] for a in at]
    assert got == pytest.approx({i: v[n].mean() for i, n in enumerate(near)})


def test_a_search_does_not_grow_with_density(spark, monkeypatch):
    met = []
    pairs = J.radius_pairs

    def counted(*a):
        out = pairs(*a)
        met.append(out.count())
        return out

    monkeypatch.setattr(J, "radius_pairs", counted)
    xy = np.random.default_rng(4).random((4000, 2))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "p int, x double, y double")
    t = spark.createDataFrame([(i, 0.5, 0.5 + i % 5 / 100) for i in range(50)], "t int, x double, y double")
    assert J.knn(p, t, "p", "t", ["x", "y"], 4, 2.0).count() == 200
    assert sum(met) < 5000  # all pairs are 200,000


def test_cusum_is_the_fold(spark):
    z = np.random.default_rng(2).integers(-20, 21, (4, 800)) / 10
    df = spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(z) for i, v in enumerate(row)] + [(9, 0, 2.0), (9, 1, None), (9, 2, 0.75)], "k int, t int, z double")
    got = {(r.k, r.i): (r.up, r.down, r.alarm) for r in R.cusum(df, "k", "t", "z").collect()}
    assert len(got) == z.size + 3 and [got[9, i][0] for i in range(3)] == [1.5, 0.0, 0.25]
    for k, row in enumerate(z):
        up = down = 0.0
        for i, v in enumerate(row):
            up, down = max(0.0, up + float(v) - 0.5), min(0.0, down + float(v) + 0.5)
            assert got[k, i] == (up, down, up > 5 or down < -5)


def test_points_on_a_plane_are_in_its_half_space(spark):
    df = spark.createDataFrame([(s, p) for s in (8, 14, 20, 22, 24) for p in (1368.75, 1200.0, 1031.25, 975.0, 918.75)], "s int, p double")
    df = df.selectExpr("(s - 10) / 40.0D x", "(p / 50 - 15) / 30.0D y")
    got = df.select("x", "y", S.half_space(["x", "y"], (0.0, 0.375), (0.6, 0.8)).alias("in"), S.half_space(["x", "y"], (0.0, 0.375), (0.6, 0.8), strict=True).alias("strictly")).collect()
    assert all(r["in"] == (r.x * 0.6 + r.y * 0.8 >= 0.3) and r.strictly == (r.x * 0.6 + r.y * 0.8 > 0.3) for r in got)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_groups_are_in_no_window(spark):
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=500).round(1), rng.normal(size=500).round(2)
    df = spark.createDataFrame([(None if i % 2 else 1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(u, v))], "k int, i int, u double, v double")
    got = {r.k: r for r in A.shape(df, "k", "u").collect()}
    quads = {r.k: r for r in A.quadrants(df, "k", "u", "v", 0.5).collect()}
    q = {r.k: r for r in A.quantiles(df, "k", "u", [0, 5, 50, 97.5, 100]).collect()}
    w = {r.k: r for r in A.wasserstein_equal(df, "k", "u", "v", "i").collect()}
    x = {(r.k, r.lag): r.r for r in T.cross_correlation(df, "k", "i", "u", "v", 3, block=16).collect()}
    for k, at in ((1, slice(0, None, 2)), (None, slice(1, None, 2))):
        a, b = u[at] - u[at].mean(), v[at] - v[at].mean()
        assert got[k].skewness == pytest.approx((a**3).mean() / (a**2).mean() ** 1.5) and got[k].flatness == pytest.approx((a**4).mean() / (a**2).mean() ** 2)
        out = np.abs(a * b) < 0.5 * a.std() * b.std()
        assert quads[k].hole_n == out.sum() and quads[k].q2_n == ((a < 0) & (b > 0) & ~out).sum()
        assert [q[k][f"p{p:g}"] for p in (0, 5, 50, 97.5, 100)] == pytest.approx(np.percentile(u[at], [0, 5, 50, 97.5, 100]).tolist())
        assert w[k].wasserstein == pytest.approx(np.abs(np.sort(u[at]) - np.sort(v[at])).mean())
        for lag in range(-3, 4):
            r = (a[lag:] * b[: len(b) - lag]).sum() if lag >= 0 else (a[:lag] * b[-lag:]).sum()
            assert x[k, lag] == pytest.approx(r / np.sqrt((a * a).sum() * (b * b).sum()))
    for f in (A.shape(df, "k", "u"), A.quadrants(df, "k", "u", "v")):
        assert "Window" not in plan(f)
    assert "percentile" not in plan(A.quantiles(df, "k", "u", [50]))


def test_copies_ask_once(spark, monkeypatch):
    from fieldloom.operators import geometry as G

    met, pairs = [], G.radius_pairs

    def counted(*a):
        met.append(pairs(*a).count())
        return pairs(*a)

    monkeypatch.setattr(G, "radius_pairs", counted)
    p = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(60)] + [(99, 50.0, 0.0), (98, 3.5, 0.0)], "p int, x double, y double")
    got = {r.p: r.cluster for r in G.dbscan(p, "p", ["x", "y"], 1.5, 21).collect()}
    assert got == {i: 0 for i in range(60)} | {99: -1, 98: 0} and met[0] == 11  # 1,200 pairs of points and more
    t = spark.createDataFrame([(i, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0) for i in range(7, 40)], "tri int, ax double, ay double, bx double, by double, cx double, cy double")
    assert {r.p: r.tri for r in J.locate_triangles(p, t, "p", "tri", 2.0).collect()} == {i: 7 for i in range(60)} | {99: -1, 98: 7}


def test_a_value_at_the_mean_deviates_by_nothing(spark):
    v = [0.1, 0.7, 0.3, 0.4, 0.5, 0.4, 0.4, 0.6, 0.2, 0.4]  # the mean is 0.4
    rates = set()
    for turn in range(5):
        rows = [(turn, i, x) for i, x in enumerate(v)]
        rates.add(T.features(spark.createDataFrame(rows[turn:] + rows[:turn], "k int, i int, x double").coalesce(1), "k", "i", "x").first().zero_crossing_rate)
    s = [(x > 0.4) - (x < 0.4) for x in v]
    assert rates == {sum(a != b for a, b in zip(s, s[1:])) / 9}


def test_bootstrap_parts_of_a_group(spark):
    df = spark.range(400).selectExpr("id % 2 k", "id i", "cast(id % 17 as double) x")
    key = lambda d: sorted(tuple(round(x, 9) for x in r) for r in d.collect())
    assert key(D.bootstrap_mean(df, "k", "i", "x", 40, part=30)) == key(D.bootstrap_mean(df, "k", "i", "x", 40))


def test_helmholtz_parts(spark):
    n = 8
    y, x = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    u, v = np.sin(2 * np.pi * x / n) + 0.3, np.cos(2 * np.pi * x / n)  # u has no curl, v no divergence
    df = spark.createDataFrame([(0, int(i), int(j), float(u[i, j]), float(v[i, j])) for i in range(n) for j in range(n)], "c int, i int, j int, u double, v double")
    for r in X.helmholtz(df, "c", "i", "j", "u", "v").collect():
        assert abs(r.irrotational_u - u[r.i, r.j]) < 1e-9 and abs(r.solenoidal_v - v[r.i, r.j]) < 1e-9 and abs(r.solenoidal_u) < 1e-9


def test_least_squares_and_gates(spark):
    df = spark.createDataFrame([("g", i, float(i), 2.0 * i + 1) for i in range(30)], "g string, i int, x double, y double").withColumn("one", F.lit(1.0))
    w = {r.i: r.weights for r in R.recursive_least_squares(df, "g", "i", ["x", "one"], "y", 1.0, 1e6).collect()}
    assert np.allclose(w[29], [2, 1], atol=1e-3)
    times = spark.createDataFrame([("g", t) for t in (0.0, 0.0, 0.4, 1.0, 1.5, 2.1, None)], "g string, t double")
    assert [r.t for r in R.spaced(times, "g", "t", 1.0).orderBy("t").collect()] == [0.0, 1.0, 2.1]


def test_splits_and_violations(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 50).withColumn("y", F.col("id") % 3)
    assert S.hash_split(df, "g").groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["count"] for r in S.stratified_split(df, "y", "id", (0.5, 0.25, 0.25)).groupBy("y", "split").count().filter("split = 'train'").collect()} == {167, 166}
    assert S.k_folds(df, "id", 5).select("fold").distinct().count() == 5
    bad = spark.createDataFrame([("a",), ("a",), (" ",), ("b",)], "k string")
    got = {(r.key, r.problem) for r in S.violations(bad, "k", bad.filter("k = 'a'"), "k").collect()}
    assert got == {("a", "repeated"), (" ", "blank"), (" ", "orphan"), ("b", "orphan")}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, i int, x double")
    for df in (T.features(e, "k", "i", "x"), A.box_stats(e, "k", "x"), R.cusum(e, "k", "i", "x"), T.rolling(e, "k", "i", "x", 3), A.error_metrics(e, "k", "x", "x"), R.welch(e, "k", "i", "x")):
        assert df.count() == 0


def test_facade(spark, wave):
    assert facade.run("running_moments", wave, "k", "x").first().n == 256
    assert "quantile" in facade.list_operations("statistics")
    with pytest.raises(KeyError):
        facade.run("nothing", wave)


def test_designs(spark):
    h = D.latin_hypercube(spark, 40, [(0.0, 1.0), (-1.0, 1.0)], 3).toPandas()
    assert sorted(np.floor(h.x0 * 40)) == list(range(40)) and sorted(np.floor((h.x1 + 1) * 20)) == list(range(40))
    x = np.random.default_rng(0).normal(5, 2, 400)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, i int, x double")
    r = D.bootstrap_mean(df, "g", "i", "x").first()
    half = 1.645 * x.std() / 20
    assert r.mean == pytest.approx(x.mean()) and abs(r.lower - (x.mean() - half)) < 0.06 and abs(r.upper - (x.mean() + half)) < 0.06
