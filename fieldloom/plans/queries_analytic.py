"""Registered query of numeric fields against exact solutions; parts are triangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import analytic

from .queries import load, query, rounded

_AREA = "(({p}x-px)*({q}y-py)-({q}x-px)*({p}y-py))"
_A, _B, _C = (_AREA.format(p=p, q=q) for p, q in (("e", "c"), ("c", "a"), ("a", "e")))  # e: the name by is taken in SQL


@query(f"""
WITH t AS (SELECT p_partkey AS k, p_size::double AS ax, (p_partkey%7)::double AS ay, p_size+9.0e0 AS ex, p_partkey%7+0.5e0 AS ey, p_size::double AS cx, p_partkey%7+5.0e0 AS cy, p_retailprice/1000 AS va, p_retailprice/900 AS vb, p_retailprice/800 AS vc FROM part),
q AS (SELECT s_suppkey AS s, s_suppkey%40*0.31e0 AS py, (SELECT (min(ax)+max(ex))/2 FROM t) AS px, 0.25e0*(s_suppkey%40*0.31e0)*(12-s_suppkey%40*0.31e0) AS u FROM supplier),
m AS (SELECT s, u, arg_min(({_A}*va+{_B}*vb+{_C}*vc)/({_A}+{_B}+{_C}), k) AS v FROM q JOIN t ON least({_A},{_B},{_C})>=-1e-12 GROUP BY 1,2),
a AS (SELECT q.s, q.u, m.v FROM q LEFT JOIN m ON m.s=q.s), o AS (SELECT avg(u) AS b FROM m)
SELECT count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_outside, round(sqrt(avg(power(v-u,2)) FILTER (WHERE v IS NOT NULL)),6) AS rmse, round(1-sum(power(v-u,2))/sum(power(u-b,2)) FILTER (WHERE v IS NOT NULL),6) AS r2,
 round(sqrt(sum(power(v-u,2)))/sqrt(sum(u*u) FILTER (WHERE v IS NOT NULL)),6) AS relative_l2, round(max(abs(v-u)),6) AS max_error FROM a, o""")
def compare_against_analytic(spark, sf_dir):
    k, s, p = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    d = lambda c: c.cast("double")
    t = load(spark, sf_dir, "part").select(
        k.alias("k"), d(s).alias("ax"), d(k % 7).alias("ay"), (s + 9.0).alias("bx"), (k % 7 + 0.5).alias("by"), d(s).alias("cx"), (k % 7 + 5.0).alias("cy"),
        (p / 1000).alias("va"), (p / 900).alias("vb"), (p / 800).alias("vc"),
    )
    y = F.col("s_suppkey") % 40 * 0.31
    profile = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), y.alias("at"), analytic.plane_poiseuille(y, -1.0, 2.0, 12.0).alias("exact"))
    got = analytic.compare_against_analytic(t, profile, "k", [["va", "vb", "vc"]], 4.0)
    return rounded(got.select("n", "n_outside", "rmse", "r2", "relative_l2", "max_error"))
