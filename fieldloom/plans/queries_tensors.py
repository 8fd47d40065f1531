"""Registered queries of cases on common grids; brands are cases, parts triangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import tensors

from .queries import load, query, rounded

_CELLS = """t AS (SELECT p_brand AS c, p_partkey AS k, p_size::double AS ax, (p_partkey%7)::double AS ay, p_size+6.0e0 AS bx, (p_partkey%7)::double AS ey, p_size::double AS cx, p_partkey%7+5.0e0 AS cy, p_retailprice/100 AS va, p_retailprice/100+p_partkey%3 AS vb, p_retailprice/100-p_partkey%5 AS vc FROM part),
b AS (SELECT min(ax) AS x0, max(bx) AS x1, min(ay) AS y0, max(cy) AS y1 FROM t), w AS (SELECT x0-(x1-x0)*0.02e0 AS ox, y0-(y1-y0)*0.02e0 AS oy, x0+(x1-x0)+(x1-x0)*0.02e0 AS hx, y0+(y1-y0)+(y1-y0)*0.02e0 AS hy FROM b),
g AS (SELECT ox, oy, greatest(hx-ox, hy-oy)/24 AS h, round((hx-ox)/(greatest(hx-ox, hy-oy)/24))::bigint+1 AS nx, round((hy-oy)/(greatest(hx-ox, hy-oy)/24))::bigint+1 AS ny FROM w),
n AS (SELECT ox+i*h AS px, oy+j*h AS py, i, j, h, nx, ny FROM g, range(200) r(i), range(200) s(j) WHERE i<nx AND j<ny),
d AS (SELECT c, k, i, j, va, vb, vc, ((cy-ay)*(px-ax)-(cx-ax)*(py-ay))/((bx-ax)*(cy-ay)-(cx-ax)*(ey-ay)) AS u, ((bx-ax)*(py-ay)-(ey-ay)*(px-ax))/((bx-ax)*(cy-ay)-(cx-ax)*(ey-ay)) AS v FROM t, n),
f AS (SELECT c, i, j, arg_min((1-u-v)*va+u*vb+v*vc, k) AS p FROM d WHERE least(1-u-v, u, v) >= -1e-12 GROUP BY ALL)"""


@query(f"""WITH {_CELLS}, q AS (SELECT p_brand AS c, avg(p_size) AS m FROM part GROUP BY 1), a AS (SELECT q.c, m, n.*, f.p, f.p IS NOT NULL AS ok FROM q JOIN n ON true LEFT JOIN f ON f.c=q.c AND f.i=n.i AND f.j=n.j),
s AS (SELECT x.c, x.m, x.i, x.j, x.nx, x.ny, x.h, x.p, x.ok, min(sqrt(power((x.i-y.i)*x.h,2)+power((x.j-y.j)*x.h,2))) FILTER (WHERE y.ok<>x.ok) AS near FROM a x JOIN a y ON y.c=x.c GROUP BY ALL),
z AS (SELECT *, coalesce(near, h*sqrt(power(nx-1,2)+power(ny-1,2))) AS e, (i//4)*((ny+3)//4)+j//4 AS tile, (i%4)*least(ny-j//4*4,4)+j%4 AS o FROM s),
r AS (SELECT c, tile, o, unnest([{{'n':'sdf','v':CASE WHEN ok THEN e ELSE -e END}}, {{'n':'mask','v':ok::int::double}}, {{'n':'size','v':m}}, {{'n':'p','v':coalesce(p,0)}}]) AS l FROM z)
SELECT c AS "case", tile::bigint AS tile, l.n AS name, count(*) AS n, round(sum(l.v::float::double),4) AS total, round(sum(o*l.v::float::double),3) AS moment FROM r GROUP BY ALL""")
def cases_to_grid_tensors(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    at = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    s, k, v = F.col("p_size"), F.col("p_partkey"), F.col("p_retailprice") / 100
    cells = part.select(F.col("p_brand").alias("case"), k.alias("cell"), F.array(at(s, k % 7), at(s + 6, k % 7), at(s, k % 7 + 5)).alias("corners"), F.array(v, v + k % 3, v - k % 5).alias("p"))
    params = part.groupBy(F.col("p_brand").alias("case")).agg(F.avg("p_size").alias("size"))
    blocks = tensors.cases_to_grid_tensors(cells, params, "case", "cell", "corners", ["p"], ["size"], resolution=24, tile=4)
    at_ = blocks.select("case", "tile", "name", F.posexplode("data").alias("o", "v")).withColumn("v", F.col("v").cast("double"))
    sums = at_.groupBy("case", "tile", "name").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("o") * F.col("v")).alias("moment"))
    return rounded(sums, 4, moment=3)
