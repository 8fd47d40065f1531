"""Registered queries of geometry operators; triangles and tetrahedra are built from rows of ``part`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import geometry as G
from fieldloom.operators import surfaces

from .queries import load, query, rounded

_TRI = """tri AS (SELECT p_brand g, p_partkey k, p_size*1.0e0 ax, (p_partkey%7)*1.0e0 ay, (p_partkey%5)*0.5e0 az, p_size+1.0e0 bx, (p_partkey%7)*1.0e0 "by", (p_partkey%3)*0.25e0 bz,
 p_size*1.0e0 cx, (p_partkey%7)+2.0e0 cy, (p_partkey%4)*0.3e0 cz, p_retailprice/100 p, (p_partkey%11)*0.1e0 ux, (p_partkey%13)*0.2e0 uy, (p_partkey%17)*0.3e0 uz FROM part),
s AS (SELECT *, 0.5e0*(("by"-ay)*(cz-az)-(bz-az)*(cy-ay)) sx, 0.5e0*((bz-az)*(cx-ax)-(bx-ax)*(cz-az)) sy, 0.5e0*((bx-ax)*(cy-ay)-("by"-ay)*(cx-ax)) sz FROM tri)"""


def _triangles(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("g"), k.alias("k"), (s * 1.0).alias("ax"), (k % 7 * 1.0).alias("ay"), (k % 5 * 0.5).alias("az"), (s + 1.0).alias("bx"), (k % 7 * 1.0).alias("by"), (k % 3 * 0.25).alias("bz"),
        (s * 1.0).alias("cx"), (k % 7 + 2.0).alias("cy"), (k % 4 * 0.3).alias("cz"), (F.col("p_retailprice") / 100).alias("p"), (k % 11 * 0.1).alias("ux"), (k % 13 * 0.2).alias("uy"), (k % 17 * 0.3).alias("uz"),
    )


@query(f"""WITH {_TRI}, f AS (SELECT *, -(p-8)*sx fx, -(p-8)*sy fy, -(p-8)*sz fz, (ax+bx+cx)/3-1 rx, (ay+"by"+cy)/3-2 ry, (az+bz+cz)/3-3 rz FROM s)
SELECT g, round(sum(fx),7) fx, round(sum(fy),7) fy, round(sum(fz),7) fz, round(sum(ry*fz-rz*fy),8) mx, round(sum(rz*fx-rx*fz),8) my, round(sum(rx*fy-ry*fx),8) mz FROM f GROUP BY 1""")
def surface_forces(spark, sf_dir):
    return rounded(G.pressure_forces(_triangles(spark, sf_dir), "g", "p", (1.0, 2.0, 3.0), 8.0), 7, mx=8, my=8, mz=8)


@query(f"""WITH {_TRI}, f AS (SELECT *, ux*sx+uy*sy+uz*sz un, sqrt(sx*sx+sy*sy+sz*sz) a, ux*ux+uy*uy+uz*uz u2 FROM s)
SELECT g, round(sum(un),5) flow, round(sum(1.2*un),5) mass_flux, round(sum(1.2*p*un),8) scalar_flux, round(sum(0.6*u2*un),6) energy_flux, round(sum(a),5) area, round(sum(p*a)/sum(a),6) area_average, round(sum(1.2*p*un)/sum(1.2*un),6) mass_weighted_average FROM f GROUP BY 1""")
def plane_flux(spark, sf_dir):
    return rounded(G.plane_flux(_triangles(spark, sf_dir), "g", "u", "p", 1.2), 5, scalar_flux=8, energy_flux=6, area_average=6, mass_weighted_average=6)


@query("""
WITH p AS (SELECT s_suppkey id, (s_suppkey%5)*1.0 x, (s_suppkey%7)*0.5 y, (s_suppkey%3)*2.0+s_acctbal/10000 z FROM supplier),
t AS (SELECT a.id, b.x-a.x bx, b.y-a.y "by", b.z-a.z bz, c.x-a.x cx, c.y-a.y cy, c.z-a.z cz, d.x-a.x dx, d.y-a.y dy, d.z-a.z dz FROM p a JOIN p b ON b.id=a.id+1 JOIN p c ON c.id=a.id+2 JOIN p d ON d.id=a.id+3)
SELECT id, round(abs(bx*(cy*dz-cz*dy)+"by"*(cz*dx-cx*dz)+bz*(cx*dy-cy*dx))/6,6) volume FROM t""")
def tet_volumes(spark, sf_dir):
    k = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier")
    points = s.select(k.alias("point_id"), (k % 5 * 1.0).alias("x"), (k % 7 * 0.5).alias("y"), (k % 3 * 2.0 + F.col("s_acctbal") / 10000).alias("z"))
    cells = s.select(k.alias("id"), F.array(k, k + 1, k + 2, k + 3).alias("v"))
    return rounded(G.with_corners(cells, points, "v", "abcd").select("id", G.tet_volume().alias("volume")))


@query("""
WITH t AS (SELECT unnest([s_suppkey, s_suppkey+1, s_suppkey+2]) node, s_acctbal/3 m FROM supplier) SELECT node, round(sum(m),5) mass FROM t GROUP BY 1""")
def lumped_mass_matrix(spark, sf_dir):
    k = F.col("s_suppkey")
    return rounded(G.lumped_mass(load(spark, sf_dir, "supplier").select(F.array(k, k + 1, k + 2).alias("v"), F.col("s_acctbal").alias("a")), "v", "a"), 5)


@query("""SELECT l_suppkey%20 r, l_partkey%20 c, round(sum(l_quantity*1.0),3) v FROM lineitem GROUP BY 1,2""")
def coo_assembly(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 20).alias("c"), F.col("l_quantity").alias("v"))
    return rounded(G.assemble(d, "r", "c", "v"), 3)


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey id, (s_suppkey*7%50)*1.0 x, (s_suppkey*13%60)*1.0 y FROM supplier),
n AS (SELECT a.id a, b.id b FROM p a JOIN p b ON sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=7.5), c AS (SELECT a id FROM n GROUP BY 1 HAVING count(*)>=3),
e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)), r AS (SELECT id, id l FROM c UNION SELECT e.b, r.l FROM r JOIN e ON e.a=r.id), f AS (SELECT id, min(l) l FROM r GROUP BY 1)
SELECT p.id, coalesce((SELECT l FROM f WHERE f.id=p.id), (SELECT min(l) FROM n JOIN f ON f.id=n.b WHERE n.a=p.id), -1) AS "cluster" FROM p""")
def dbscan(spark, sf_dir):
    k = F.col("s_suppkey")
    p = load(spark, sf_dir, "supplier").select(k.alias("id"), (k * 7 % 50 * 1.0).alias("x"), (k * 13 % 60 * 1.0).alias("y"))
    return rounded(G.dbscan(p, "id", ["x", "y"], 7.5, 3))


_SEGMENT = "power(px-{u}x-t{k}*({v}x-{u}x),2)+power(py-{u}y-t{k}*({v}y-{u}y),2)+power(pz-{u}z-t{k}*({v}z-{u}z),2)"
_CLAMPED = "least(1.0, greatest(0.0, ((px-{u}x)*({v}x-{u}x)+(py-{u}y)*({v}y-{u}y)+(pz-{u}z)*({v}z-{u}z)) / (power({v}x-{u}x,2)+power({v}y-{u}y,2)+power({v}z-{u}z,2))))"
_SIDES = (("a", "e", 0), ("e", "c", 1), ("c", "a", 2))  # e: the name by is taken in SQL


@query(f"""
WITH t AS (SELECT s_suppkey AS tri, (s_suppkey % 50)::double AS ax, s_acctbal/500 AS ay, s_nationkey::double AS az FROM supplier),
u AS (SELECT *, ax+9 AS ex, ay+tri%3 AS ey, az+1 AS ez, ax AS cx, ay+4 AS cy, az+tri%5 AS cz FROM t),
p AS (SELECT p_partkey AS pid, p_size*1.0::double AS px, p_retailprice/50 AS py, (p_partkey%37)::double AS pz FROM part),
n AS (SELECT *, (ey-ay)*(cz-az)-(ez-az)*(cy-ay) AS nx, (ez-az)*(cx-ax)-(ex-ax)*(cz-az) AS ny, (ex-ax)*(cy-ay)-(ey-ay)*(cx-ax) AS nz, {', '.join(f'{_CLAMPED.format(u=u, v=v)} AS t{k}' for u, v, k in _SIDES)} FROM u, p),
o AS (SELECT *, nx*nx+ny*ny+nz*nz AS nn, (px-ax)*nx+(py-ay)*ny+(pz-az)*nz AS h FROM n),
b AS (SELECT *, px-h*nx/nn AS qx, py-h*ny/nn AS qy, pz-h*nz/nn AS qz FROM o),
i AS (SELECT *, {' AND '.join(f'(({v}y-{u}y)*(qz-{u}z)-({v}z-{u}z)*(qy-{u}y))*nx+(({v}z-{u}z)*(qx-{u}x)-({v}x-{u}x)*(qz-{u}z))*ny+(({v}x-{u}x)*(qy-{u}y)-({v}y-{u}y)*(qx-{u}x))*nz >= 0' for u, v, _ in _SIDES)} AS inside FROM b)
SELECT pid, round(sqrt(min(least({', '.join(_SEGMENT.format(u=u, v=v, k=k) for u, v, k in _SIDES)}, CASE WHEN inside THEN h*h/nn ELSE 'infinity'::double END))), 6) AS distance FROM i GROUP BY pid""")
def surface_distance(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tri"), (F.col("s_suppkey") % 50).cast("double").alias("ax"), (F.col("s_acctbal") / 500).alias("ay"), F.col("s_nationkey").cast("double").alias("az"))
    t = s.selectExpr("tri", "ax", "ay", "az", "ax + 9 bx", "ay + tri % 3 by", "az + 1 bz", "ax cx", "ay + 4 cy", "az + tri % 5 cz")
    p = load(spark, sf_dir, "part").selectExpr("p_partkey pid", "cast(p_size as double) x", "p_retailprice / 50 y", "cast(p_partkey % 37 as double) z")
    return rounded(surfaces.nearest_triangle(p, t, "pid", "tri", 2.0).select("pid", "distance"), 6)


@query("""
WITH c AS (SELECT avg(p_size)::double AS m FROM part), p AS (SELECT p_partkey, abs(p_size - m) + abs(p_retailprice/40 - m) + abs((p_partkey%50) - m) AS d FROM part, c)
SELECT p_partkey, d < 30 AS inside, CASE WHEN d < 30 THEN round((30 - d)/sqrt(3), 6) END AS depth FROM p""")
def wall_features(spark, sf_dir):
    """Points in and around a closed octahedron; inside, the distance is that to the nearest of its planes."""
    p = load(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size as double) x", "p_retailprice / 40 y", "cast(p_partkey % 50 as double) z")
    tip = lambda axis, sign: F.array(*(F.col("m") + (30.0 * sign if i == axis else 0.0) for i in range(3)))
    faces = []
    for x in (1, -1):
        for y in (1, -1):
            for z in (1, -1):  # corners so that normals point outward
                v = [tip(0, x), tip(1, y), tip(2, z)] if x * y * z > 0 else [tip(0, x), tip(2, z), tip(1, y)]
                faces.append(F.struct(F.lit(4 * x + 2 * y + z).alias("tri"), *(w[i].alias(f"{n}{k}") for n, w in zip("abc", v) for i, k in enumerate("xyz"))))
    t = p.agg(F.avg("x").alias("m")).select(F.explode(F.array(*faces)).alias("f")).select("f.*")
    found = surfaces.attach_wall_features(p, t, "p_partkey", "tri", 8.0)
    return rounded(found.select("p_partkey", (F.col("wall_sdf") < 0).alias("inside"), F.when(F.col("wall_sdf") < 0, F.col("wall_distance")).alias("depth")), 6)
