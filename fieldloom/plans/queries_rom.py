"""Registered queries of regimes, growing sets of modes, bases over a parameter, mesh hashes and designs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.operators import bases as B
from fieldloom.operators import meshhash, sampling
from fieldloom.operators import trajectories as T
from fieldloom.operators.incremental import IncrementalModes

from .queries import load, query, rounded

_POINTS = """
WITH RECURSIVE p AS (SELECT user_id, i AS "start", x, y FROM (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, avg(value) OVER f AS x, avg(10.0*length(event_type)) OVER f AS y, count(*) OVER f AS n
    FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5),
seeds AS (SELECT row_number() OVER (ORDER BY md5(user_id || '-' || "start")) - 1 AS j, x, y FROM p ORDER BY md5(user_id || '-' || "start") LIMIT 3),
c(it, j, x, y) AS (SELECT 0, j, x, y FROM seeds UNION ALL
    SELECT it + 1, j, avg(px), avg(py) FROM (
        SELECT c.it, p.user_id, p."start", any_value(p.x) AS px, any_value(p.y) AS py, arg_min(c.j, power(p.x - c.x, 2) + power(p.y - c.y, 2)) AS j FROM p, c WHERE c.it < 40 GROUP BY ALL) GROUP BY it, j),
l AS (SELECT p.user_id, p."start", any_value(p.x) AS x, any_value(p.y) AS y, arg_min(c.j, power(p.x - c.x, 2) + power(p.y - c.y, 2)) AS label FROM p, c WHERE it = 40 GROUP BY ALL),
s AS (SELECT label AS j, count(*) AS n, avg(x*x + y*y) AS q, avg(x) AS mx, avg(y) AS my FROM l GROUP BY label),
d AS (SELECT l.*, s.j, s.n, x*x + y*y - 2*(x*mx + y*my) + q AS m FROM l, s),
v AS (SELECT user_id, "start", label, max(m * n / (n - 1)) FILTER (j = label) AS a, min(m) FILTER (j <> label) AS b FROM d GROUP BY ALL),
w AS (SELECT user_id, "start", label, (b - a) / greatest(a, b) AS silhouette FROM v)
"""


def _regimes(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("a0"), (10.0 * F.length("event_type")).alias("a1"))
    points = T.window_means(df, "user_id", ["ts", "event_id"], ["a0", "a1"], 5)
    seeds = points.orderBy(F.md5(F.concat_ws("-", "user_id", "start"))).limit(3).collect()
    return T.trajectory_clustering(df, "user_id", ["ts", "event_id"], ["a0", "a1"], 5, 3, centers=[(r["a0"], r["a1"]) for r in seeds], max_iter=40)


@query(_POINTS + 'SELECT user_id, "start", label, round(silhouette, 6) AS silhouette FROM w')
def trajectory_clustering(spark, sf_dir):
    return rounded(_regimes(spark, sf_dir).labels.select("user_id", "start", "label", "silhouette"), 6)


@query(_POINTS + "SELECT j AS label, n, round(c.x, 6) AS a0, round(c.y, 6) AS a1, (SELECT round(avg(silhouette), 6) FROM w) AS silhouette FROM c JOIN s USING (j) WHERE it = 40")
def trajectory_centers(spark, sf_dir):
    found = _regimes(spark, sf_dir)
    return rounded(found.centers.select("label", "n", "a0", "a1").join(F.broadcast(found.silhouette)), 6)


@query(_POINTS + """, g AS (SELECT *, "start" - row_number() OVER (PARTITION BY user_id, label ORDER BY "start") AS g FROM l)
SELECT user_id, label, min("start") AS "start", max("start") + 1 AS "end", count(*) AS length FROM g GROUP BY user_id, label, g""")
def trajectory_runs(spark, sf_dir):
    return rounded(_regimes(spark, sf_dir).runs.select("user_id", "label", "start", "end", "length"), 6)


_FLAGS = """
WITH x AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') / 100 AS a, sum(l_quantity) FILTER (l_returnflag = 'N') / 100 AS n, sum(l_quantity) FILTER (l_returnflag = 'R') / 100 AS r FROM lineitem GROUP BY 1),
y AS (SELECT coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM x),
"""
_ROOTS = "e AS (SELECT sqrt((t + sqrt(t * t - 4 * d)) / 2) AS s0, sqrt((t - sqrt(t * t - 4 * d)) / 2) AS s1 FROM g) SELECT mode, round(CASE mode WHEN 0 THEN s0 ELSE s1 END, 4) AS sigma FROM e, range(2) AS t(mode)"


def _growing(spark, sf_dir, **options):
    x = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg((F.sum("l_quantity") / 100).alias("x"))
    state = IncrementalModes(n_modes=5, **options)
    for flags in (["A", "N"], ["R"]):
        state = state.update(x.filter(F.col("l_returnflag").isin(flags)), "l_returnflag", "l_suppkey", "x")
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(state.sigma[:2])], "mode long, sigma double")


@query(_FLAGS + """z AS (SELECT a - m AS a, n - m AS n, r - m AS r FROM (SELECT *, (a + n + r) / 3 AS m FROM y)),
k AS (SELECT sum(a*a) AS aa, sum(n*n) AS nn, sum(r*r) AS rr, sum(a*n) AS an, sum(a*r) AS ar, sum(n*r) AS nr FROM z),
g AS (SELECT aa + nn + rr AS t, aa*nn - an*an + aa*rr - ar*ar + nn*rr - nr*nr AS d FROM k),
""" + _ROOTS)
def incremental_pod(spark, sf_dir):
    """Singular values of three snapshots less their mean, after a batch of two and a batch of one."""
    return rounded(_growing(spark, sf_dir, center="exact"), 4)


@query(_FLAGS + """z AS (SELECT 0.5 * (n - (a + n) / 2) AS u, r - (a + n + r) / 3 AS v FROM y),
k AS (SELECT sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv FROM z), g AS (SELECT uu + vv AS t, uu*vv - uv*uv AS d FROM k),
""" + _ROOTS)
def incremental_pod_forgetting(spark, sf_dir):
    """The same with running means, where each snapshot halves what came before it."""
    return rounded(_growing(spark, sf_dir, forget=0.5), 4)


_SUMS = """
WITH s AS (SELECT l_suppkey, k AS param, sum(CASE WHEN l_linenumber <= k THEN l_quantity ELSE 0 END) AS q FROM lineitem, range(1, 5) AS t(k) GROUP BY 1, 2),
z AS (SELECT l_suppkey, param, q - avg(q) OVER (PARTITION BY param) AS z FROM s),
v AS (SELECT l_suppkey, param, z / sqrt(sum(z * z) OVER (PARTITION BY param)) AS phi FROM z)
"""


def _bases(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    upto = line.groupBy("l_suppkey").agg(*(F.sum(F.when(F.col("l_linenumber") <= k, F.col("q")).otherwise(0.0)).alias(f"q{k}") for k in range(1, 5)))
    each = upto.select("l_suppkey", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("param"), F.col(f"q{k}").alias("q")) for k in range(1, 5)))).alias("x")).select("l_suppkey", "x.*")
    sums = each.groupBy("param").agg(F.avg("q").alias("m"), F.sqrt(F.var_pop("q") * F.count("*")).alias("norm"), F.count("*").alias("n"))
    both = each.join(F.broadcast(sums), "param")
    modes = F.array(F.struct(F.lit(0).alias("mode"), (1 / F.sqrt("n")).alias("phi")), F.struct(F.lit(1).alias("mode"), ((F.col("q") - F.col("m")) / F.col("norm")).alias("phi")))
    return both.select("param", F.col("l_suppkey").alias("point"), F.explode(modes).alias("x")).select("param", "point", "x.*")


@query(_SUMS + """, c AS (SELECT sum(a.phi * b.phi) AS c, count(*) AS n FROM v a JOIN v b USING (l_suppkey) WHERE a.param = 2 AND b.param = 3),
y AS (SELECT l_suppkey, a.phi * cos(0.25 * th) + (b.phi - c * a.phi) / sqrt(1 - c * c) * sin(0.25 * th) AS y, n FROM v a JOIN v b USING (l_suppkey), (SELECT c, n, least(acos(c), pi() / 4) AS th FROM c) WHERE a.param = 2 AND b.param = 3)
SELECT mode, l_suppkey AS point, round(CASE mode WHEN 0 THEN 1 / sqrt(n) ELSE y END, 6) AS phi FROM y, range(2) AS t(mode)""")
def basis_interpolate(spark, sf_dir):
    return rounded(B.basis_interpolate(_bases(spark, sf_dir), 2.25)[0], 6)


@query(_SUMS + "SELECT a.param AS i, round(sqrt(1 - power(sum(a.phi * b.phi), 2)), 6) AS distance FROM v a JOIN v b ON a.l_suppkey = b.l_suppkey AND b.param = a.param + 1 GROUP BY 1")
def basis_distance_curve(spark, sf_dir):
    inner = B.products(_bases(spark, sf_dir))
    return rounded(spark.createDataFrame(list(zip(inner.params, B.distance_curve(inner))), "i long, distance double"), 6)


_M = "(('0x' || substr(md5({t}), {at}, 15))::hugeint)"


@query(f"""
WITH o AS (SELECT p_brand AS b, p_partkey AS pid, p_size AS x, p_retailprice AS y, p_partkey % 10 AS z, lead(p_partkey) OVER w AS v1, lead(p_partkey, 2) OVER w AS v2 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
p AS (SELECT b || '-1' AS mesh, pid, x, y, z FROM o UNION ALL SELECT b || '-2', -pid, x, y, z FROM o UNION ALL SELECT b || '-3', pid, x, y, z + (pid = (SELECT min(p_partkey) FROM part WHERE p_brand = b))::int FROM o),
c AS (SELECT b || '-1' AS mesh, pid AS a, v1 AS d, v2 AS e FROM o WHERE v2 IS NOT NULL UNION ALL SELECT b || '-2', -v1, -v2, -pid FROM o WHERE v2 IS NOT NULL UNION ALL SELECT b || '-3', pid, v1, v2 FROM o WHERE v2 IS NOT NULL),
h AS (SELECT mesh, pid, {_M.format(t="t", at=1)} AS h0, {_M.format(t="t", at=16)} AS h1 FROM (SELECT *, round(x / 0.01)::bigint || ',' || round(y / 0.01)::bigint || ',' || round(z / 0.01)::bigint AS t FROM p)),
hp AS (SELECT mesh, count(*) AS n_points, sum(h0)::varchar || ':' || sum(h1)::varchar AS coordinate_hash FROM h GROUP BY 1),
k AS (SELECT mesh, '3:' || (x.h0 + y.h0 + z.h0)::varchar || ':' || (x.h1 + y.h1 + z.h1)::varchar AS t FROM c JOIN h x USING (mesh) JOIN h y USING (mesh) JOIN h z USING (mesh) WHERE x.pid = a AND y.pid = d AND z.pid = e),
hc AS (SELECT mesh, count(*) AS n_cells, sum({_M.format(t="t", at=1)})::varchar || ':' || sum({_M.format(t="t", at=16)})::varchar AS topology_hash FROM k GROUP BY 1)
SELECT mesh, n_points, n_cells, coordinate_hash, topology_hash, min(mesh) OVER (PARTITION BY coordinate_hash, topology_hash) AS same_as FROM hp JOIN hc USING (mesh)""")
def mesh_classes(spark, sf_dir):
    """Meshes of parts, each with a renumbered and reordered copy, which has the same hashes, and one in which a point moved."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    o = load(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 10).cast("double").alias("z"), F.lead("p_partkey").over(w).alias("v1"), F.lead("p_partkey", 2).over(w).alias("v2"), (F.row_number().over(w) == 1).cast("double").alias("first"))
    copy = lambda k: F.concat("b", F.lit(f"-{k}")).alias("mesh")
    p = o.select(copy(1), "pid", "x", "y", "z").unionByName(o.select(copy(2), (-F.col("pid")).alias("pid"), "x", "y", "z")).unionByName(o.select(copy(3), "pid", "x", "y", (F.col("z") + F.col("first")).alias("z")))
    t = o.filter("v2 is not null")
    c = t.select(copy(1), F.array("pid", "v1", "v2").alias("v")).unionByName(t.select(copy(2), F.array(-F.col("v1"), -F.col("v2"), -F.col("pid")).alias("v"))).unionByName(t.select(copy(3), F.array("pid", "v1", "v2").alias("v")))
    hashes = meshhash.mesh_hashes(p, c.orderBy(F.desc("mesh")), "mesh", "pid", ["x", "y", "z"], "v", 0.01)
    return meshhash.mesh_classes(hashes, "mesh")


@query("""
WITH RECURSIVE m2(k, m) AS (SELECT 1, 1::bigint UNION ALL SELECT k + 1, xor(2 * m, m) FROM m2 WHERE k < 32),
m3(k, m, n) AS (SELECT 1, 1::bigint, 3::bigint UNION ALL SELECT k + 1, n, xor(xor(2 * n, 4 * m), m) FROM m3 WHERE k < 32),
v AS (SELECT 0 AS d, k, (1::bigint << (32 - k)::int) AS v FROM m2 UNION ALL SELECT 1, k, m << (32 - k)::int FROM m2 UNION ALL SELECT 2, k, m << (32 - k)::int FROM m3),
g AS (SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS g FROM part),
x AS (SELECT p_partkey, d, coalesce(bit_xor(v) FILTER ((g >> (k - 1)::int) & 1 = 1), 0) / 4294967296.0::double AS u FROM g, v GROUP BY 1, 2)
SELECT p_partkey, round(max(u) FILTER (d = 0), 8) AS x0, round(-1 + 3 * max(u) FILTER (d = 1), 8) AS x1, round(10 * max(u) FILTER (d = 2), 8) AS x2 FROM x GROUP BY 1""")
def sobol_design(spark, sf_dir):
    """A Sobol point for each part, by its number."""
    x = sampling.sobol_point(F.col("p_partkey"), [(0.0, 1.0), (-1.0, 2.0), (0.0, 10.0)])
    return rounded(load(spark, sf_dir, "part").select("p_partkey", *(c.alias(f"x{i}") for i, c in enumerate(x))), 8)


_DRAW = "('0x' || substr(md5('7-{what}-' || p_partkey), 1, 8))::bigint"


@query(f"""
WITH l AS (SELECT p_partkey, p_brand, {_DRAW.format(what="level-u")} % 6 AS u, {_DRAW.format(what="level-v")} % 6 AS v, {_DRAW.format(what="order-u")} AS ou, {_DRAW.format(what="order-v")} AS ov FROM part),
s AS (SELECT *, CASE WHEN u < 5 THEN 1 ELSE -1 END AS su, CASE WHEN v < 5 THEN 1 ELSE -1 END AS sv, (ou, 'u') < (ov, 'v') AS first FROM l),
e AS (SELECT p_brand, 'u' AS moved, (pow(2 * (u + su) / 5.0::double, 2) - pow(2 * u / 5.0::double, 2)) * (1 + 3 * CASE WHEN first THEN v ELSE v + sv END / 5.0::double) / (su / 5.0::double) AS e FROM s
  UNION ALL SELECT p_brand, 'v', pow(2 * CASE WHEN first THEN u + su ELSE u END / 5.0::double, 2) * (3 * sv / 5.0::double) / (sv / 5.0::double) FROM s)
SELECT p_brand, moved, round(avg(abs(e)), 6) AS mu_star, round(stddev_pop(e), 6) AS sigma, count(*) AS n FROM e GROUP BY 1, 2""")
def morris_trajectories(spark, sf_dir):
    """Elementary effects of u * u * v by brand, a walk a part."""
    walks = sampling.morris_walks(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey", {"u": (0.0, 2.0), "v": (1.0, 4.0)}, 6, 7)
    named = walks.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").withColumn("f", F.col("u") * F.col("u") * F.col("v"))
    return rounded(sampling.elementary_effects(named, "p_partkey", "f", 6, "p_brand"), 6)
