"""The registered queries: operators applied to the driver's tables, each with the DuckDB SQL of the same result.

Roles of the tables: ``events`` is a sensor stream (a series a user), ``lineitem`` cells with volumes (quantity) and fields
(price), ``part`` and ``customer`` scattered points and parameters, ``orders`` a long univariate sample.
Floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import expression, scalars
from fieldloom.operators import aggregates as A
from fieldloom.operators import joins as J
from fieldloom.operators import recursions as R
from fieldloom.operators import relations as S
from fieldloom.operators import series as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLAGS = ["l_returnflag", "l_linestatus"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
TIME = ["ts", "event_id"]
SCALE = 0.73105857863  # keeps means of two-digit decimals off the edges of rounding


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1e6")


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Floating columns rounded, whole numbers as long."""
    out = []
    for c, t in df.dtypes:
        col = F.col(c)
        out.append(F.round(col, other.get(c, digits)).alias(c) if t == "double" else col.cast("long").alias(c) if t in ("int", "smallint", "bigint") else col)
    return df.select(*out)


# --- Aggregations -------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT l_returnflag, l_linestatus, l_quantity AS u, l_discount * 100 AS v, l_tax * 100 AS w FROM lineitem),
b AS (SELECT l_returnflag, l_linestatus, avg(u) mean_u, avg(v) mean_v, avg(w) mean_w, stddev_pop(u) rms_u, stddev_pop(v) rms_v, stddev_pop(w) rms_w,
  covar_pop(u,u) cov_u_u, covar_pop(u,v) cov_u_v, covar_pop(u,w) cov_u_w, covar_pop(v,v) cov_v_v, covar_pop(v,w) cov_v_w, covar_pop(w,w) cov_w_w FROM a GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(mean_u,6) mean_u, round(mean_v,6) mean_v, round(mean_w,6) mean_w, round(rms_u,6) rms_u, round(rms_v,6) rms_v, round(rms_w,6) rms_w,
  round(cov_u_u,6) cov_u_u, round(cov_u_v,6) cov_u_v, round(cov_u_w,6) cov_u_w, round(cov_v_v,6) cov_v_v, round(cov_v_w,6) cov_v_w, round(cov_w_w,6) cov_w_w,
  round(0.5*(cov_u_u+cov_v_v+cov_w_w),6) tke,
  round(sqrt((cov_u_u+cov_v_v+cov_w_w)/3)/greatest(sqrt(mean_u*mean_u+mean_v*mean_v+mean_w*mean_w),1e-30),6) intensity FROM b""")
def reynolds_stats(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*FLAGS, F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"), (F.col("l_tax") * 100).alias("w"))
    return rounded(A.reynolds(d, FLAGS, "u", "v", "w"))


@query("""SELECT user_id, round(stddev_pop(value)/(abs(avg(value))+1e-30),6) AS intensity FROM events GROUP BY 1""")
def turbulence_intensity(spark, sf_dir):
    return rounded(A.intensity_1d(load(spark, sf_dir, "events"), "user_id", "value"))


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) m FROM lineitem GROUP BY 1,2),
d AS (SELECT l.l_returnflag, l.l_linestatus, l_quantity - m AS d FROM lineitem l JOIN m ON l.l_returnflag=m.l_returnflag AND l.l_linestatus=m.l_linestatus)
SELECT l_returnflag, l_linestatus, round(avg(d*d*d)/greatest(pow(avg(d*d),1.5),1e-30),6) skewness, round(avg(d*d*d*d)/greatest(avg(d*d)*avg(d*d),1e-30),6) flatness FROM d GROUP BY 1,2""")
def skewness_flatness(spark, sf_dir):
    return rounded(A.shape(load(spark, sf_dir, "lineitem"), FLAGS, "l_quantity"))


@query("""SELECT user_id, count(value) n, round(avg(value),6) mean, round(var_pop(value),4) var, round(coalesce(var_samp(value),0),4) var_sample FROM events GROUP BY 1""")
def running_moments(spark, sf_dir):
    return rounded(A.running_moments(load(spark, sf_dir, "events"), "user_id", "value"), var=4, var_sample=4)


@query("""SELECT l_returnflag, l_linestatus, round(covar_pop(l_quantity,l_discount),6) cov, round(corr(l_quantity,l_discount),6) corr FROM lineitem GROUP BY 1,2""")
def running_covariance(spark, sf_dir):
    return rounded(A.running_covariance(load(spark, sf_dir, "lineitem"), FLAGS, "l_quantity", "l_discount"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice,0.05),3) p5, round(quantile_cont(l_extendedprice,0.25),3) p25, round(quantile_cont(l_extendedprice,0.5),3) p50,
 round(quantile_cont(l_extendedprice,0.75),3) p75, round(quantile_cont(l_extendedprice,0.95),3) p95 FROM lineitem GROUP BY 1""")
def quantile(spark, sf_dir):
    return rounded(A.quantiles(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [5, 25, 50, 75, 95]), 3)


@query("""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice,0.25) q1, quantile_cont(o_totalprice,0.5) median, quantile_cont(o_totalprice,0.75) q3 FROM orders GROUP BY 1),
j AS (SELECT o.o_orderpriority, o_totalprice x, q1, median, q3, q3-q1 iqr FROM orders o JOIN q ON o.o_orderpriority=q.o_orderpriority)
SELECT o_orderpriority, round(first(median),3) median, round(first(q1),3) q1, round(first(q3),3) q3, round(first(iqr),3) iqr,
 round(min(CASE WHEN x>=q1-0.2*iqr AND x<=q3+0.2*iqr THEN x END),3) whisker_low, round(max(CASE WHEN x>=q1-0.2*iqr AND x<=q3+0.2*iqr THEN x END),3) whisker_high,
 count(*) FILTER (WHERE NOT (x>=q1-0.2*iqr AND x<=q3+0.2*iqr)) n_outliers, round(min(x),3) "min", round(max(x),3) "max" FROM j GROUP BY 1""")
def box_stats(spark, sf_dir):
    return rounded(A.box_stats(load(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 0.2), 3)


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) rn, count(*) OVER (PARTITION BY user_id) n FROM events)
SELECT user_id, round(coalesce(avg(CASE WHEN rn > floor(n*0.1) AND rn <= n-floor(n*0.1) THEN value END), quantile_cont(value,0.5)),6) trimmed_mean FROM r GROUP BY 1""")
def trimmed_mean(spark, sf_dir):
    return rounded(A.trimmed_mean(load(spark, sf_dir, "events"), "user_id", "value", "event_id"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) rn, count(*) OVER (PARTITION BY user_id) n FROM events),
c AS (SELECT *, max(CASE WHEN rn = floor(n*0.05)+1 THEN value END) OVER (PARTITION BY user_id) lo, max(CASE WHEN rn = n-floor(n*0.05) THEN value END) OVER (PARTITION BY user_id) hi FROM r)
SELECT user_id, round(avg(least(greatest(value,lo),hi)),6) winsorized_mean FROM c GROUP BY 1""")
def winsorized_mean(spark, sf_dir):
    return rounded(A.winsorized_mean(load(spark, sf_dir, "events"), "user_id", "value", "event_id"))


@query("""
WITH f AS (SELECT l_linestatus, l_quantity - avg(l_quantity) OVER (PARTITION BY l_linestatus) a, l_discount*100 - avg(l_discount*100) OVER (PARTITION BY l_linestatus) b FROM lineitem),
g AS (SELECT *, a*b uv, 0.5*sqrt(avg(a*a) OVER (PARTITION BY l_linestatus))*sqrt(avg(b*b) OVER (PARTITION BY l_linestatus)) h FROM f)
SELECT l_linestatus, count(*) FILTER (WHERE abs(uv)<h) hole_n,
 count(*) FILTER (WHERE a>0 AND b>0 AND abs(uv)>=h) q1_n, round(coalesce(sum(uv) FILTER (WHERE a>0 AND b>0 AND abs(uv)>=h),0),2) q1_uv,
 count(*) FILTER (WHERE a<0 AND b>0 AND abs(uv)>=h) q2_n, round(coalesce(sum(uv) FILTER (WHERE a<0 AND b>0 AND abs(uv)>=h),0),2) q2_uv,
 count(*) FILTER (WHERE a<0 AND b<0 AND abs(uv)>=h) q3_n, round(coalesce(sum(uv) FILTER (WHERE a<0 AND b<0 AND abs(uv)>=h),0),2) q3_uv,
 count(*) FILTER (WHERE a>0 AND b<0 AND abs(uv)>=h) q4_n, round(coalesce(sum(uv) FILTER (WHERE a>0 AND b<0 AND abs(uv)>=h),0),2) q4_uv FROM g GROUP BY 1""")
def quadrant_analysis(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"))
    return rounded(A.quadrants(d, "l_linestatus", "u", "v", 0.5), 2)


@query("""
WITH b AS (SELECT least(floor((o_totalprice-0.0)/(500000.0-0.0)*40)::int, 39) bin FROM orders WHERE o_totalprice BETWEEN 0 AND 500000),
c AS (SELECT r.range AS bin, count(b.bin) n FROM range(40) r LEFT JOIN b ON b.bin = r.range GROUP BY 1)
SELECT bin, n, round(n/(sum(n) OVER ()*(500000.0/40)+1e-30)*1e6,6) pdf FROM c""")
def histogram_pdf(spark, sf_dir):
    return rounded(A.histogram_pdf(load(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 40).withColumn("pdf", F.col("pdf") * 1e6))


@query("""
WITH b AS (SELECT least(floor(l_quantity/51.0*8)::int,7) bx, least(floor(l_discount/0.11*8)::int,7) c FROM lineitem WHERE l_quantity BETWEEN 0 AND 51 AND l_discount BETWEEN 0 AND 0.11)
SELECT bx, c AS "by", count(*) n, round(count(*)/(sum(count(*)) OVER () * (51.0*0.11/64)),6) density FROM b GROUP BY 1,2""")
def joint_pdf_2d(spark, sf_dir):
    return rounded(A.joint_pdf(load(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (0.0, 51.0), (0.0, 0.11), 8))


@query("""
WITH s AS (SELECT pow(count(c_acctbal),-0.2)*stddev_pop(c_acctbal) h FROM customer), p AS (SELECT unnest([0.0,1000.0,2500.0,5000.0,9000.0]) point)
SELECT point, round(avg(exp(-0.5*pow((point-c_acctbal)/h,2))/(h*sqrt(2*pi())))*1e6,6) pdf FROM customer, s, p GROUP BY 1""")
def kde_pdf(spark, sf_dir):
    return rounded(A.kde_pdf(load(spark, sf_dir, "customer"), "c_acctbal", [0, 1000, 2500, 5000, 9000]).withColumn("pdf", F.col("pdf") * 1e6))


@query("""
WITH b AS (SELECT (epoch_us(ts)//3600000000) % 24 AS h, value FROM events),
g AS (SELECT h, count(*) n, avg(value) m, stddev_pop(value) r FROM b GROUP BY 1)
SELECT r.range AS phase_bin, coalesce(n,0) n, round(coalesce(m,0),6) mean, round(coalesce(g.r,0),6) rms FROM range(24) r LEFT JOIN g ON g.h = r.range""")
def phase_average(spark, sf_dir):
    # Half a second in, so that no sample lies on a bin's edge.
    d = load(spark, sf_dir, "events").select(F.floor(seconds()).alias("t"), "value").withColumn("t", F.col("t") + 0.5)
    return rounded(A.phase_average(d, "t", "value", 86400.0, 24))


@query("""SELECT user_id, round(coalesce(avg(value) FILTER (WHERE event_type='purchase'),0),6) mean, count(*) FILTER (WHERE event_type='purchase') n FROM events GROUP BY 1""")
def conditional_average(spark, sf_dir):
    return rounded(A.conditional_average(load(spark, sf_dir, "events"), "user_id", "value", F.col("event_type") == "purchase"))


@query("""
WITH a AS (SELECT user_id, value > 50 c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) j FROM events),
r AS (SELECT user_id, count(*) l FROM a WHERE c GROUP BY user_id, i-j),
g AS (SELECT user_id, count(*) n, avg(l) m, max(l) x, sum(l) t FROM r GROUP BY 1), s AS (SELECT user_id, count(*) n FROM events GROUP BY 1)
SELECT s.user_id, coalesce(g.n,0) n_events, round(coalesce(m,0)*1.0,6) mean_duration, round(coalesce(x,0)*1.0,6) max_duration, round(coalesce(t,0)*1.0,6) total_duration, round(coalesce(t,0)/s.n,6) active_fraction FROM s LEFT JOIN g ON g.user_id=s.user_id""")
def event_duration_stats(spark, sf_dir):
    return rounded(A.event_durations(load(spark, sf_dir, "events"), "user_id", TIME, F.col("value") > 50))


@query("""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, floor(count(*) OVER (PARTITION BY user_id)/10) s FROM events),
m AS (SELECT user_id, floor(i/s) b, avg(value) m FROM a WHERE s>0 AND floor(i/s)<10 GROUP BY 1,2)
SELECT user_id, round(avg(m),6) mean, round(stddev_samp(m)/sqrt(count(*)),6) standard_error FROM m GROUP BY 1""")
def batch_means_se(spark, sf_dir):
    return rounded(A.batch_means(load(spark, sf_dir, "events"), "user_id", TIME, "value", 10))


@query("""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, count(*) OVER (PARTITION BY user_id) n FROM events),
g AS (SELECT user_id, avg(value) FILTER (WHERE i<floor(n*0.3)) ma, var_samp(value) FILTER (WHERE i<floor(n*0.3)) va, count(value) FILTER (WHERE i<floor(n*0.3)) na,
  avg(value) FILTER (WHERE i>=n-floor(n*0.5)) mb, var_samp(value) FILTER (WHERE i>=n-floor(n*0.5)) vb, count(value) FILTER (WHERE i>=n-floor(n*0.5)) nb FROM a GROUP BY 1)
SELECT user_id, round((ma-mb)/sqrt(va/na+vb/nb+1e-30),6) z FROM g""")
def geweke_diagnostic(spark, sf_dir):
    return rounded(A.geweke(load(spark, sf_dir, "events"), "user_id", TIME, "value", first=0.3))


@query("""SELECT user_id, round(avg(value),6) mean, round(stddev_pop(value),6) std, round(min(value),6) "min", round(max(value),6) "max", round(sqrt(avg(value*value)),6) rms FROM events GROUP BY 1""")
def probe_statistics(spark, sf_dir):
    return rounded(A.probe_statistics(load(spark, sf_dir, "events"), "user_id", "value"))


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(corr({a},{b}),6) r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(_PAIRS)
def pearson_matrix(spark, sf_dir):
    return rounded(A.pearson_matrix(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("""
WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) p_retailprice FROM part)
SELECT p_brand, round(corr(p_size,p_retailprice),6) r_p_size_p_retailprice FROM r GROUP BY 1""")
def spearman_matrix(spark, sf_dir):
    return rounded(A.spearman_matrix(load(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"], "p_partkey"))


@query("""
WITH a AS (SELECT l_returnflag, sum(l_quantity*l_extendedprice/1000) i, sum(l_quantity) v, sum(l_quantity*(l_extendedprice/1000)*(l_extendedprice/1000)) s FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(i,2) integral, round(i/v,6) average, round(greatest(s/v-(i/v)*(i/v),0),4) variance FROM a""")
def cell_volume_integrals(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("f", F.col("l_extendedprice") / 1000)
    return rounded(A.volume_integrals(d, "l_returnflag", "l_quantity", "f"), integral=2, variance=4)


@query("""SELECT p_brand, round(sum(pow(p_size,3))/(sum(pow(p_size,2))+1e-30),6) sauter_mean FROM part GROUP BY 1""")
def sauter_mean(spark, sf_dir):
    return rounded(A.sauter_mean(load(spark, sf_dir, "part"), "p_brand", "p_size"))


@query("""SELECT p_brand, round(1/avg(1/p_retailprice),6) effective FROM part GROUP BY 1""")
def effective_conductivity(spark, sf_dir):
    return rounded(A.harmonic_mean(load(spark, sf_dir, "part"), "p_brand", "p_retailprice"))


@query("""
WITH a AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1)//8 AS block FROM events)
SELECT user_id, block, round(avg(value),6) mean FROM a GROUP BY 1,2 HAVING count(*)=8""")
def block_average(spark, sf_dir):
    return rounded(A.block_average(load(spark, sf_dir, "events"), "user_id", TIME, "value", 8))


@query("""
WITH a AS (SELECT l_returnflag, l_extendedprice/1000 t, l_extendedprice/1000*(1-l_discount) p, avg(l_extendedprice/1000) OVER (PARTITION BY l_returnflag) m FROM lineitem),
g AS (SELECT l_returnflag, avg((p-t)*(p-t)) mse, sum((p-t)*(p-t)) res, sum((t-m)*(t-m)) tot, sum(t*t) sq, max(abs(p-t)) mx, avg(abs(p-t)) mae, avg(p-t) bias, max(t)-min(t) rg, abs(avg(t)) mn, stddev_pop(t) sd FROM a GROUP BY 1)
SELECT l_returnflag, round(sqrt(mse),6) rmse, round(1-res/tot,6) r2, round(sqrt(res)/(sqrt(sq)+1e-30),6) relative_l2, round(mx,6) max_error, round(mae,6) mae, round(bias,6) bias,
 round(sqrt(mse)/rg,6) nrmse_range, round(sqrt(mse)/mn,6) nrmse_mean, round(sqrt(mse)/sd,6) nrmse_std FROM g""")
def surrogate_metrics(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("t"), (F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount"))).alias("p"))
    return rounded(A.error_metrics(d, "l_returnflag", "t", "p"))


@query("""SELECT l_returnflag, count(*) size, 0::bigint n_nan, 0::bigint n_inf, count(*) n_finite, round(min(l_quantity),6) "min", round(max(l_quantity),6) "max", round(avg(l_quantity),6) mean, round(stddev_pop(l_quantity),6) std,
 count(*) FILTER (WHERE l_quantity<5) n_below, count(*) FILTER (WHERE l_quantity>45) n_above FROM lineitem GROUP BY 1""")
def field_sanity_check(spark, sf_dir):
    return rounded(A.field_sanity(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", (5.0, 45.0)))


@query("""SELECT l_returnflag, round(avg((l_quantity BETWEEN 10 AND 30 + l_discount*100)::int),6) picp FROM lineitem GROUP BY 1""")
def picp(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.lit(10.0).alias("lo"), (30 + F.col("l_discount") * 100).alias("hi"))
    return rounded(A.coverage(d, "l_returnflag", "l_quantity", "lo", "hi"))


@query("""
WITH a AS (SELECT (p_size*2-1)/100.0 c, p_retailprice > 1000 ok FROM part),
b AS (SELECT least(ceil(c*10)::int-1,9) bin, count(*) n, avg(c) c, avg(ok::int) a FROM a WHERE c>0 GROUP BY 1)
SELECT round(sum(n/(SELECT count(*) FROM a)*abs(b.a-b.c)),6) ece FROM b""")
def calibration_error(spark, sf_dir):
    d = load(spark, sf_dir, "part").select(((F.col("p_size") * 2 - 1) / 100.0).alias("c"), (F.col("p_retailprice") > 1000).alias("ok"))
    return rounded(A.ece(d, "c", "ok"))


@query("""
WITH v AS (SELECT l_returnflag, l_quantity x, count(*) FILTER (WHERE l_linestatus='O') a, count(*) FILTER (WHERE l_linestatus<>'O') b FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1,2),
g AS (SELECT l_returnflag, abs(sum(a) OVER w / sum(a) OVER e - sum(b) OVER w / sum(b) OVER e) gap FROM v WINDOW w AS (PARTITION BY l_returnflag ORDER BY x), e AS (PARTITION BY l_returnflag))
SELECT l_returnflag, round(max(gap),6) ks FROM g GROUP BY 1""")
def ks_stat(spark, sf_dir):
    return rounded(A.ks_statistic(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", F.col("l_linestatus") == "O"))


@query("""
WITH e AS (SELECT quantile_cont(l_extendedprice,[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) q FROM lineitem WHERE l_linestatus='O'),
b AS (SELECT l_linestatus='O' x, CASE WHEN l_extendedprice>=q[1]-1e-9 AND l_extendedprice<=q[11]+1e-9 THEN len(list_filter(q[2:10], lambda z: z<=l_extendedprice)) END bin FROM lineitem, e),
c AS (SELECT r.range bin, count(*) FILTER (WHERE x) ne, count(*) FILTER (WHERE NOT x) na FROM range(10) r LEFT JOIN b ON b.bin=r.range GROUP BY 1),
p AS (SELECT greatest(ne/(SELECT count(*) FROM b WHERE x),1e-6) pe, greatest(na/(SELECT count(*) FROM b WHERE NOT x),1e-6) pa FROM c)
SELECT round(sum((pa-pe)*ln(pa/pe)),6) psi FROM p""")
def psi(spark, sf_dir):
    return rounded(A.psi(load(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_linestatus") == "O"))


@query("""
WITH a AS (SELECT l_returnflag, l_quantity x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn FROM lineitem),
b AS (SELECT l_returnflag, l_extendedprice/1000 y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice/1000, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn FROM lineitem)
SELECT a.l_returnflag, round(avg(abs(x-y)),6) wasserstein FROM a JOIN b ON a.l_returnflag=b.l_returnflag AND a.rn=b.rn GROUP BY 1""")
def wasserstein_1d(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return rounded(A.wasserstein_equal(d, "l_returnflag", "l_quantity", "y", LINE))


@query("""SELECT l_partkey, round(sum(l_quantity*l_extendedprice/1370)/sum(l_quantity),6) average, round(var_pop(l_extendedprice/1370),5) variance FROM lineitem GROUP BY 1""")
def ensemble_average(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1370)
    return rounded(A.weighted_ensemble(d, "l_partkey", "p", "l_quantity"), variance=5)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) rn FROM events)
SELECT event_type, count(*) "count", round(min_by(value, rn),6) latest, round(avg(value),6) mean, round(stddev_pop(value),6) std, round(min(value),6) "min", round(max(value),6) "max" FROM r WHERE rn<=100 GROUP BY 1""")
def dashboard(spark, sf_dir):
    return rounded(A.dashboard(load(spark, sf_dir, "events"), "event_type", TIME, "value", 100))


@query("""
WITH f AS (SELECT user_id, ((event_type<>'error') <> lag(event_type<>'error') OVER (PARTITION BY user_id ORDER BY ts, event_id))::int f FROM events)
SELECT user_id, round(coalesce(avg(f),0),6) flakiness FROM f GROUP BY 1""")
def flakiness(spark, sf_dir):
    return rounded(A.flip_rate(load(spark, sf_dir, "events"), "user_id", TIME, F.col("event_type") != "error"))


@query("""
WITH m AS (SELECT p_size, avg(p_retailprice) m, var_samp(p_retailprice)/count(p_retailprice) v FROM part GROUP BY 1)
SELECT round(sum(m),3) estimate, round(sum(v),3) variance FROM m""")
def mlmc_estimate(spark, sf_dir):
    return rounded(A.two_level_estimate(load(spark, sf_dir, "part"), "p_size", "p_retailprice"), 3)


@query("""
WITH p AS (SELECT floor(l_quantity/5) i, l_quantity/5 - floor(l_quantity/5) f, l_tax w FROM lineitem),
d AS (SELECT i node, w*(1-f) m FROM p UNION ALL SELECT i+1, w*f FROM p)
SELECT node::bigint node, round(sum(m),4) mass FROM d WHERE node BETWEEN 0 AND 9 GROUP BY 1""")
def deposit_cic(spark, sf_dir):
    return rounded(A.deposit_cic(load(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", 10, 5.0), 4)


# --- Ordered series -----------------------------------------------------------------------------------------------


@query("""
WITH ev AS (SELECT user_id, event_id, ts, value*0.73105857863 AS value FROM events), s AS (SELECT user_id, count(*) n, avg(value) mean, stddev_pop(value) std, min(value) mn, max(value) mx, quantile_cont(value,0.25) q25, quantile_cont(value,0.5) med, quantile_cont(value,0.75) q75 FROM ev GROUP BY 1),
d AS (SELECT e.user_id, value x, n, mean, std, mn, mx, q25, med, q75, row_number() OVER w - 1 i, lag(value) OVER w p, value-mean dev, lag(value-mean) OVER w b,
  coalesce(value>lag(value,1) OVER w AND value>lag(value,2) OVER w AND value>lag(value,3) OVER w AND value>lead(value,1) OVER w AND value>lead(value,2) OVER w AND value>lead(value,3) OVER w, false) pk,
  value>mean ab, row_number() OVER w - row_number() OVER (PARTITION BY e.user_id, value>mean ORDER BY ts, event_id) isle,
  CASE WHEN mx>mn THEN least(floor((value-mn)/(mx-mn)*10),9) ELSE 0 END bin
  FROM ev e JOIN s ON s.user_id=e.user_id WINDOW w AS (PARTITION BY e.user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, max(c) l FROM (SELECT user_id, isle, count(*) c FROM d WHERE ab GROUP BY 1,2) GROUP BY 1),
h AS (SELECT user_id, -sum(p*ln(p)) h FROM (SELECT user_id, bin, count(*)/first(n) p FROM d GROUP BY 1,2) GROUP BY 1),
g AS (SELECT user_id, first(n) n, first(mean) mean, first(std) std, first(mn) mn, first(mx) mx, first(med) med, first(q75-q25) iqr, avg(CASE WHEN x>=q75 THEN x END) ma, count(*) FILTER (WHERE pk) np, coalesce(min(i) FILTER (WHERE ab),-1) fa,
  avg((x<0)::int) pz, coalesce(sum(abs(x-p)),0) tv, coalesce(avg(abs(x-p)),0) mc, sum(dev*b) num, sum(dev*dev) den, regr_slope(x,i) sl, max(abs(x)) pa, sqrt(avg(x*x)) rms, count(*) FILTER (WHERE sign(dev)<>sign(b)) cr FROM d GROUP BY 1)
SELECT g.user_id, round(mean,6) mean, round(std,6) std, round(mn,6) "min", round(mx,6) "max", round(med,6) median, round(iqr,6) iqr, round(ma,6) mean_above_q75, coalesce(l,0) long_run_above_mean, np n_peaks, fa first_above_mean, round(pz,6) pct_below_zero,
 round(tv,4) total_variation, round(mc,6) mean_abs_change, round(CASE WHEN n<2 OR den<1e-30 THEN 0 ELSE num/den END,6) acf_lag1, round(CASE WHEN n<2 THEN 0 ELSE coalesce(sl,0) END,6) trend_slope, round(CASE WHEN rms<1e-30 THEN 0 ELSE pa/rms END,6) crest_factor,
 round(CASE WHEN n<2 THEN 0 ELSE h END,6) shannon_entropy, round(CASE WHEN n<2 THEN 0 ELSE cr/(n-1) END,6) zero_crossing_rate
FROM g LEFT JOIN l ON l.user_id=g.user_id JOIN h ON h.user_id=g.user_id""")
def ts_features(spark, sf_dir):
    d = load(spark, sf_dir, "events").withColumn("value", F.col("value") * SCALE)
    return rounded(T.features(d, "user_id", TIME, "value"), total_variation=4)


@query("""SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id))*0.73105857863,6) fluctuation FROM events""")
def fluctuation(spark, sf_dir):
    return rounded(T.fluctuation(load(spark, sf_dir, "events"), "user_id", "value").select("event_id", (F.col("fluctuation") * SCALE).alias("fluctuation")))


@query("""SELECT event_id, round(avg(value*0.73105857863) OVER w,6) running_mean, round(sqrt(greatest(avg(pow(value*0.73105857863,2)) OVER w - pow(avg(value*0.73105857863) OVER w,2),0)),4) running_rms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_statistics(spark, sf_dir):
    d = load(spark, sf_dir, "events").withColumn("x", F.col("value") * SCALE)
    return rounded(T.running_statistics(d, "user_id", TIME, "x").select("event_id", "running_mean", "running_rms"), running_rms=4)


_MIRROR = """
WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, count(*) OVER (PARTITION BY user_id) n FROM events),
m AS (SELECT user_id, event_id, value, i, false pad FROM a UNION ALL SELECT user_id, event_id, value, -i, true FROM a WHERE i BETWEEN 1 AND {h} UNION ALL SELECT user_id, event_id, value, 2*(n-1)-i, true FROM a WHERE i>=n-1-{h} AND i<=n-2)"""


@query(_MIRROR.format(h=2) + ", w AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) r FROM m) SELECT event_id, round(r,6) rolled FROM w WHERE NOT pad")
def moving_average(spark, sf_dir):
    return rounded(T.rolling(load(spark, sf_dir, "events"), "user_id", TIME, "value", 5).select("event_id", "rolled"))


@query(_MIRROR.format(h=2) + ", w AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) l FROM m) SELECT event_id, round(list_sort(l)[3],6) rolled FROM w WHERE NOT pad")
def moving_median(spark, sf_dir):
    return rounded(T.rolling(load(spark, sf_dir, "events"), "user_id", TIME, "value", 5, "median").select("event_id", "rolled"))


@query(_MIRROR.format(h=3) + """, w AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) l FROM m),
d AS (SELECT *, list_sort(l)[4] med FROM w WHERE NOT pad), x AS (SELECT *, list_sort(list_transform(l, lambda v: abs(v-med)))[4] mad FROM d)
SELECT event_id, round(med,6) median, round(mad,6) mad, round(CASE WHEN mad<1e-30 THEN 0 ELSE abs(value-med)/mad END,4) score, round(CASE WHEN mad>=1e-30 AND abs(value-med)>3.0*1.4826*mad THEN med ELSE value END,6) filtered FROM x""")
def hampel_filter(spark, sf_dir):
    return rounded(T.hampel(load(spark, sf_dir, "events"), "user_id", TIME, "value").select("event_id", "median", "mad", "score", "filtered"), score=4)


_SG = T.savgol_weights(7, 3)


@query(_MIRROR.format(h=3) + ", w AS (SELECT *, " + " + ".join(f"({c!r})*" + (f"lead(value,{k}) OVER o" if k > 0 else f"lag(value,{-k}) OVER o" if k < 0 else "value") for c, k in zip(_SG, range(-3, 4))) + " s FROM m WINDOW o AS (PARTITION BY user_id ORDER BY i)) SELECT event_id, round(s,5) smoothed FROM w WHERE NOT pad")
def denoise(spark, sf_dir):
    return rounded(T.savgol(load(spark, sf_dir, "events"), "user_id", TIME, "value", 7).select("event_id", "smoothed"), 5)


@query("""SELECT o_orderkey, round(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)/(count(*) OVER (PARTITION BY o_orderpriority)+1),8) ecdf FROM orders""")
def empirical_cdf(spark, sf_dir):
    return rounded(T.empirical_cdf(load(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", "ecdf"), 8)


@query("""
WITH a AS (SELECT user_id, event_id, (value>=60)::int - lag((value>=60)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i FROM events)
SELECT user_id, event_id, i, CASE WHEN s=1 THEN 'rising' ELSE 'falling' END direction FROM a WHERE s<>0""")
def threshold_crossings(spark, sf_dir):
    return rounded(T.crossings(load(spark, sf_dir, "events"), "user_id", TIME, "value", 60.0, "both").select("user_id", "event_id", "i", "direction"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) cm FROM events),
b AS (SELECT *, abs(lead(cm,10) OVER (PARTITION BY user_id ORDER BY i)-cm)/(abs(cm)+1e-30)<0.05 ok FROM a)
SELECT user_id, coalesce(min(i) FILTER (WHERE ok),-1) plateau_index FROM b GROUP BY 1""")
def plateau_detector(spark, sf_dir):
    return rounded(T.plateau(load(spark, sf_dir, "events"), "user_id", TIME, "value", 10, 0.05))


@query("""
WITH a AS (SELECT user_id, value-avg(value) OVER (PARTITION BY user_id) d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
v AS (SELECT user_id, avg(d*d) v FROM a GROUP BY 1)
SELECT a.user_id, (b.i-a.i) AS lag, round(avg(a.d*b.d)/first(v),6) r FROM a JOIN a b ON a.user_id=b.user_id AND b.i-a.i BETWEEN 0 AND 8 JOIN v ON v.user_id=a.user_id GROUP BY 1,2""")
def two_point_acf(spark, sf_dir):
    return rounded(T.autocorrelation(load(spark, sf_dir, "events"), "user_id", TIME, "value", 8))


@query("""
WITH a AS (SELECT user_id, value-avg(value) OVER (PARTITION BY user_id) d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
v AS (SELECT user_id, avg(d*d) v FROM a GROUP BY 1),
r AS (SELECT a.user_id, (b.i-a.i) AS lag, avg(a.d*b.d)/first(v) r FROM a JOIN a b ON a.user_id=b.user_id AND b.i-a.i BETWEEN 0 AND 8 JOIN v ON v.user_id=a.user_id GROUP BY 1,2),
k AS (SELECT *, max((r<0)::int) OVER (PARTITION BY user_id ORDER BY lag) neg FROM r),
t AS (SELECT user_id, (r+lag(r) OVER (PARTITION BY user_id ORDER BY lag))/2 a FROM k WHERE neg=0)
SELECT user_id, round(coalesce(sum(a),0),6) length_scale FROM t GROUP BY 1""")
def integral_length_scale(spark, sf_dir):
    return rounded(T.integral_scale(T.autocorrelation(load(spark, sf_dir, "events"), "user_id", TIME, "value", 8), "user_id"))


@query("""
WITH a AS (SELECT l_returnflag||l_linestatus k, l_quantity-avg(l_quantity) OVER (PARTITION BY l_returnflag,l_linestatus) a, l_discount-avg(l_discount) OVER (PARTITION BY l_returnflag,l_linestatus) b, row_number() OVER (PARTITION BY l_returnflag,l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) i FROM lineitem),
n AS (SELECT k, sqrt(sum(a*a)*sum(b*b))+1e-30 n FROM a GROUP BY 1)
SELECT x.k, (x.i-y.i) AS lag, round(sum(x.a*y.b)/first(n),6) r FROM a x JOIN a y ON x.k=y.k AND x.i-y.i BETWEEN -3 AND 3 JOIN n ON n.k=x.k GROUP BY 1,2""")
def cross_correlation(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus"))
    return rounded(T.cross_correlation(d, "k", LINE, "l_quantity", "l_discount", 3))


_GRID = "SELECT o_custkey%3 c, month(o_orderdate) i, year(o_orderdate)-1991 j, avg(o_totalprice)/1000 f, avg(o_custkey%97) g FROM orders GROUP BY 1,2,3"


def _grid(spark, sf_dir):
    """A field on a month-by-year grid."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 3).alias("c"), F.month("o_orderdate").cast("long").alias("i"), (F.year("o_orderdate") - 1991).cast("long").alias("j")).agg((F.avg("o_totalprice") / 1000).alias("f"), F.avg(F.col("o_custkey") % 97).alias("g"))


def _d(f: str, along: str, h: str) -> str:
    w = f"(PARTITION BY c, {'j' if along == 'i' else 'i'} ORDER BY {along})"
    return f"coalesce((lead({f}) OVER {w}-lag({f}) OVER {w})/(2*{h}), (lead({f}) OVER {w}-{f})/{h}, ({f}-lag({f}) OVER {w})/{h})"


@query(f"WITH a AS ({_GRID}), b AS (SELECT *, {_d('f', 'i', '0.5')} gx, {_d('f', 'j', '2.0')} gy FROM a) SELECT c, i, j, round(gx,5) gx, round(gy,5) gy, round({_d('gx', 'i', '0.5')}+{_d('gy', 'j', '2.0')},5) laplacian FROM b")
def grid_derivatives(spark, sf_dir):
    return rounded(T.gradients_2d(_grid(spark, sf_dir), "c", "i", "j", "f", 0.5, 2.0).select("c", "i", "j", "gx", "gy", "laplacian"), 5)


@query(f"WITH a AS ({_GRID}), b AS (SELECT *, {_d('f', 'i', '1.0')} ux, {_d('f', 'j', '1.0')} uy, {_d('g', 'i', '1.0')} vx, {_d('g', 'j', '1.0')} vy FROM a) SELECT c, i, j, round(vx-uy,5) vorticity, round(0.5*(0.5*(vx-uy)*(vx-uy)-(ux*ux+vy*vy+0.5*(uy+vx)*(uy+vx))),3) q, round(ux+vy,5) divergence FROM b")
def vorticity_q_criterion(spark, sf_dir):
    return rounded(T.rotation_2d(_grid(spark, sf_dir), "c", "i", "j", "f", "g").select("c", "i", "j", "vorticity", "q", "divergence"), 5, q=3)


@query("""
WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) o, c_acctbal/1000 x, (c_custkey%17)*1.0 y FROM customer),
b AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)),0) d FROM a WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
SELECT c_custkey, round(sum(d) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING),5) arc_length FROM b""")
def arc_length(spark, sf_dir):
    d = load(spark, sf_dir, "customer").withColumns({"x": F.col("c_acctbal") / 1000, "y": F.col("c_custkey") % 17 * 1.0})
    return rounded(T.arc_length(d, "c_nationkey", "c_custkey", ["x", "y"]).select("c_custkey", "arc_length"), 5)


@query("""
WITH a AS (SELECT user_id, event_type, row_number() OVER w - 1 i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i)-1 run FROM a)
SELECT user_id, run::bigint run, first(event_type) label, min(i) "start", max(i) "end", count(*) length FROM b GROUP BY 1,2""")
def label_runs(spark, sf_dir):
    return rounded(T.label_runs(load(spark, sf_dir, "events"), "user_id", TIME, "event_type"))


@query("""
WITH a AS (SELECT p_brand, p_size mode, sum(p_retailprice) s FROM part GROUP BY 1,2), b AS (SELECT *, sum(s*s) OVER (PARTITION BY p_brand ORDER BY mode)/sum(s*s) OVER (PARTITION BY p_brand) e FROM a)
SELECT p_brand, mode::bigint mode, round(e,8) energy FROM b""")
def pod_truncation(spark, sf_dir):
    d = load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("mode")).agg(F.sum("p_retailprice").alias("s"))
    return rounded(T.cumulative_energy(d, "p_brand", "mode", "s").select("p_brand", "mode", "energy"), 8)


@query("""
WITH a AS (SELECT user_id, value-50 e, value-lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM events)
SELECT user_id, round(coalesce(sum(s*s),0)/(sum(e*e)+1e-30),6) durbin_watson FROM a GROUP BY 1""")
def residual_diagnostics(spark, sf_dir):
    return rounded(T.durbin_watson(load(spark, sf_dir, "events").withColumn("e", F.col("value") - 50), "user_id", TIME, "e"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER w - 1 i, value d0, lead(value,2) OVER w d1, lead(value,4) OVER w d2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, i, round(d0,6) d0, round(d1,6) d1, round(d2,6) d2 FROM a WHERE d2 IS NOT NULL""")
def delay_embed(spark, sf_dir):
    return rounded(T.delay_embed(load(spark, sf_dir, "events"), "user_id", TIME, "value", 3, 2).select("user_id", "i", "d0", "d1", "d2"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER w - 1 i, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, i AS "start", round(list_sum(l),5) total FROM a WHERE i%3=0 AND len(l)=5""")
def make_windows(spark, sf_dir):
    w = T.sliding_windows(load(spark, sf_dir, "events"), "user_id", TIME, "value", 5, 3)
    return rounded(w.select("user_id", "start", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")), 5)


@query("""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i FROM events),
b AS (SELECT user_id, i//2 k, max(value) FILTER (WHERE i%2=0) a, max(value) FILTER (WHERE i%2=1) b FROM a GROUP BY 1,2)
SELECT user_id, k, round((a+b)/sqrt(2.0),6) approx, round((a-b)/sqrt(2.0),6) detail FROM b WHERE b IS NOT NULL""")
def haar_forward(spark, sf_dir):
    return rounded(T.haar(load(spark, sf_dir, "events"), "user_id", TIME, "value"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER w - 1 i, count(*) OVER (PARTITION BY user_id) n, stddev_pop(value) OVER (PARTITION BY user_id) s,
  abs(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, i, round(j,6) jump FROM a WHERE i>=5 AND i<=n-5 AND j>1.0*s""")
def window_changes(spark, sf_dir):
    return rounded(T.window_jumps(load(spark, sf_dir, "events"), "user_id", TIME, "value", 5, 1.0))


@query("""
WITH p AS (SELECT p_brand, p_size y, avg(p_retailprice) u FROM part GROUP BY 1,2), e AS (SELECT p_brand, max(u) e FROM p GROUP BY 1),
d AS (SELECT p.p_brand, y, u/e r, lag(u/e) OVER w r0, lag(y) OVER w y0 FROM p JOIN e ON e.p_brand=p.p_brand WINDOW w AS (PARTITION BY p.p_brand ORDER BY y)),
c AS (SELECT p_brand, y, y0+(0.99-r0)*(y-y0)/(r-r0) x FROM d WHERE least(r,r0)<=0.99 AND greatest(r,r0)>=0.99 AND r<>r0)
SELECT d.p_brand, round(coalesce((SELECT min_by(x,y) FROM c WHERE c.p_brand=d.p_brand), max(y)),5) delta99, round(sum((y-y0)*((1-r)+(1-r0))/2),5) displacement, round(sum((y-y0)*(r*(1-r)+r0*(1-r0))/2),5) momentum FROM d GROUP BY 1""")
def boundary_layer(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("y")).agg(F.avg("p_retailprice").alias("u"))
    d = p.join(p.groupBy("p_brand").agg(F.max("u").alias("e")), "p_brand")
    return rounded(T.boundary_layer(d, "p_brand", "y", "u", "e"), 5)


# --- Joins --------------------------------------------------------------------------------------------------------

_QT = "SELECT DISTINCT user_id, 1704067200.0 + 86400.0*d + 0.123 tq FROM events, (SELECT unnest(range(0,32)) d)"
_BR = f"""WITH q AS ({_QT}), s AS (SELECT user_id, epoch_us(ts)/1e6 t, max(value) vmax, min(value) vmin FROM events GROUP BY 1,2),
b AS (SELECT q.user_id, q.tq, a.t t0, a.vmax v0, c.t t1, c.vmin v1 FROM q ASOF LEFT JOIN s a ON a.user_id=q.user_id AND q.tq>a.t ASOF LEFT JOIN s c ON c.user_id=q.user_id AND q.tq<=c.t)"""


def _samples(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    day = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("d")
    return e, e.select("user_id").distinct().select("user_id", day).select("user_id", (F.lit(1704067200.0) + 86400.0 * F.col("d") + 0.123).alias("tq"))


@query(_BR + """, n AS (SELECT *, tq-t0 a0, t1-tq a1, least(tq-t0,t1-tq) na FROM b), m AS (SELECT *, CASE WHEN t0 IS NULL OR a1<=a0 THEN v1 ELSE v0 END nv,
 t0 IS NOT NULL AND t1 IS NOT NULL AND t1-t0<=200000 AND greatest(a0,a1)<=150000 bt FROM n),
o AS (SELECT *, CASE WHEN na IS NULL THEN NULL WHEN na<=3600 THEN (CASE WHEN na<=150000 THEN nv END) WHEN bt THEN v0+a0/(t1-t0)*(v1-v0) END v, CASE WHEN na<=3600 THEN na WHEN bt THEN greatest(a0,a1) ELSE na END age FROM m)
SELECT user_id, round(tq,3) tq, round(v,5) "value", round(age,3) age, CASE WHEN na IS NULL THEN 'missing' WHEN v IS NULL THEN 'stale' ELSE 'ok' END state FROM o""")
def align_observations(spark, sf_dir):
    s, q = _samples(spark, sf_dir)
    return rounded(J.align(s, q, "user_id", "t", "value", "tq", tolerance=3600.0, max_gap=200000.0, max_age=150000.0), 3, value=5)


@query(_BR + """ SELECT user_id, round(tq,3) tq, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1=tq THEN v1 ELSE v0+(tq-t0)/(t1-t0)*(v1-v0) END,5) "value" FROM b""")
def time_interp(spark, sf_dir):
    s, q = _samples(spark, sf_dir)
    return rounded(J.interpolate(s, q, "user_id", "t", "value", "tq"), 3, value=5)


@query(_BR + """ SELECT user_id, round(tq,3) tq, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN tq-t0<t1-tq THEN v0 ELSE v1 END,5) "value" FROM b""")
def time_interp_nearest(spark, sf_dir):
    s, q = _samples(spark, sf_dir)
    return rounded(J.interpolate(s, q, "user_id", "t", "value", "tq", "nearest"), 3, value=5)


@query("""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value>=80 hot FROM events), n AS (SELECT user_id, max(i) l FROM a GROUP BY 1),
t AS (SELECT a.user_id, i c FROM a JOIN n ON n.user_id=a.user_id WHERE hot AND i>=2 AND i+2<=l)
SELECT t.user_id, a.i-c AS "offset", count(*) n, round(avg(value),6) mean, round(stddev_pop(value),5) std FROM t JOIN a ON a.user_id=t.user_id AND a.i BETWEEN c-2 AND c+2 GROUP BY 1,2""")
def trigger_average(spark, sf_dir):
    from fieldloom.operators.frames import indexed

    s = indexed(load(spark, sf_dir, "events"), "user_id", TIME)
    return rounded(J.trigger_average(s, s.filter("value >= 80"), "user_id", "i", "value", 2), std=5)


@query("""
WITH o AS (SELECT p_partkey*1.0 lo, p_partkey*1.0+1 hi, p_retailprice u FROM part), n AS (SELECT b*7.5+0.25 lo, b*7.5+7.75 hi FROM (SELECT DISTINCT p_partkey//7 b FROM part))
SELECT round(n.lo,3) lo, round(n.hi,3) hi, round(coalesce(sum(greatest(least(o.hi,n.hi)-greatest(o.lo,n.lo),0)*u),0)/(n.hi-n.lo),5) u FROM n LEFT JOIN o ON greatest(o.lo,n.lo)<least(o.hi,n.hi) GROUP BY n.lo, n.hi""")
def conservative_remap_1d(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    old = p.select((F.col("p_partkey") * 1.0).alias("lo"), (F.col("p_partkey") * 1.0 + 1).alias("hi"), F.col("p_retailprice").alias("u"))
    b = p.select(F.floor(F.col("p_partkey") / 7).alias("b")).distinct()
    new = b.select((F.col("b") * 7.5 + 0.25).alias("lo"), (F.col("b") * 7.5 + 7.75).alias("hi"))
    return rounded(J.remap_1d(old, new, "lo", "hi", "u", 10.0), 5)


_PTS = "SELECT p_partkey pid, p_size*1.0 x, p_retailprice/20 y, p_retailprice v FROM part"
_TGT = "SELECT s_suppkey tid, (s_suppkey*7%50)*1.0+0.37 x, 45+(s_suppkey*13%60)*0.911 y FROM supplier"


def _points(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 20).alias("y"), F.col("p_retailprice").alias("v"))
    k = F.col("s_suppkey")
    return p, load(spark, sf_dir, "supplier").select(k.alias("tid"), (k * 7 % 50 * 1.0 + 0.37).alias("x"), (45 + k * 13 % 60 * 0.911).alias("y"))


@query(f"""WITH p AS ({_PTS}), t AS ({_TGT}), d AS (SELECT tid, pid, sqrt(pow(p.x-t.x,2)+pow(p.y-t.y,2)) d FROM p, t),
r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, pid) rank FROM d) SELECT tid, pid, rank, round(d,6) distance FROM r WHERE rank<=4""")
def knn_interpolate(spark, sf_dir):
    p, t = _points(spark, sf_dir)
    return rounded(J.knn(p, t, "pid", "tid", ["x", "y"], 4, 2.0))


@query(f"""WITH p AS ({_PTS}), t AS ({_TGT}), d AS (SELECT tid, pid, v, sqrt(pow(p.x-t.x,2)+pow(p.y-t.y,2)) d FROM p, t),
r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, pid) rank FROM d) SELECT tid, round(sum(v/(d*d+1e-12))/sum(1/(d*d+1e-12)),5) "value" FROM r WHERE rank<=4 GROUP BY 1""")
def idw_interpolate(spark, sf_dir):
    p, t = _points(spark, sf_dir)
    return rounded(J.idw(p, t, "pid", "tid", ["x", "y"], "v", 4, 2.0), 5)


@query(f"WITH p AS ({_PTS}), t AS ({_TGT}) SELECT tid, pid, round(sqrt(pow(p.x-t.x,2)+pow(p.y-t.y,2)),6) distance FROM p, t WHERE sqrt(pow(p.x-t.x,2)+pow(p.y-t.y,2))<=3.5")
def radius_search(spark, sf_dir):
    p, t = _points(spark, sf_dir)
    return J.radius_search(p, t, "pid", "tid", ["x", "y"], 3.5, digits=6)


@query("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size<=a.p_size AND b.p_retailprice<=a.p_retailprice AND (b.p_size<a.p_size OR b.p_retailprice<a.p_retailprice))""")
def pareto_mask(spark, sf_dir):
    return J.pareto(load(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("p_partkey")


@query("""
WITH a AS (SELECT o_custkey k, avg(o_totalprice)/1000 t FROM orders GROUP BY 1), b AS (SELECT c_custkey k, c_acctbal/50 p FROM customer), j AS (SELECT 'all' g, t, p FROM a JOIN b ON a.k=b.k)
SELECT round(sqrt(avg((p-t)*(p-t))),5) rmse, round(avg(abs(p-t)),5) mae, round(avg(p-t),5) bias, round(max(abs(p-t)),3) max_error FROM j""")
def compare_fields(spark, sf_dir):
    t = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.avg("o_totalprice") / 1000).alias("v"))
    p = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 50).alias("v"))
    m = A.error_metrics(J.compare_fields(t, p, "k", "v").withColumn("g", F.lit("all")), "g", "t", "p")
    return rounded(m.select("rmse", "mae", "bias", "max_error"), 5, max_error=3)


# --- Predicates, top-k, sets, scalars ------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 AND l_discount BETWEEN 0.02 AND 0.08 AND l_tax BETWEEN 0.01 AND 0.05""")
def box_mask(spark, sf_dir):
    return rounded(load(spark, sf_dir, "lineitem").filter(S.box("l_quantity", "l_discount", "l_tax", (5, 30, 0.02, 0.08, 0.01, 0.05))).select("l_orderkey", "l_linenumber"))


@query("""SELECT p_partkey FROM part WHERE sqrt(pow(p_size-25,2)+pow(p_retailprice/50-20,2))<=8.0""")
def sphere_mask(spark, sf_dir):
    return load(spark, sf_dir, "part").withColumn("y", F.col("p_retailprice") / 50).filter(S.sphere(["p_size", "y"], (25, 20), 8.0)).select("p_partkey")


@query("""WITH q AS (SELECT o_orderpriority k, quantile_cont(o_totalprice,0.25) a, quantile_cont(o_totalprice,0.75) b FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN q ON k=o_orderpriority WHERE o_totalprice<a-0.3*(b-a) OR o_totalprice>b+0.3*(b-a)""")
def outliers_iqr(spark, sf_dir):
    return S.outliers_iqr(load(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 0.3).filter("outlier").select("o_orderkey")


@query("""SELECT event_id FROM (SELECT event_id, abs(value-avg(value) OVER (PARTITION BY user_id))/(stddev_pop(value) OVER (PARTITION BY user_id)+1e-30) z FROM events) WHERE z>1.8""")
def outliers_zscore(spark, sf_dir):
    return S.outliers_z(load(spark, sf_dir, "events"), "user_id", "value", 1.8).filter("outlier").select("event_id")


@query("""SELECT l_orderkey, l_linenumber::bigint l_linenumber, round(abs(l_extendedprice*l_discount),4) score FROM lineitem ORDER BY abs(l_extendedprice*l_discount) DESC, l_orderkey, l_linenumber LIMIT 25""")
def hotspot_indices(spark, sf_dir):
    return rounded(S.top_k(load(spark, sf_dir, "lineitem"), F.abs(F.col("l_extendedprice") * F.col("l_discount")), LINE, 25).select("l_orderkey", "l_linenumber", "score"), 4)


@query("""SELECT l_returnflag, l_orderkey, l_linenumber::bigint l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rank FROM lineitem) WHERE rank<=5""")
def top_variance_query(spark, sf_dir):
    return rounded(S.top_k_by(load(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_extendedprice"), LINE, 5).select("l_returnflag", "l_orderkey", "l_linenumber", "rank"))


@query("""
WITH e AS (SELECT p_size*1.0 x, p_retailprice/50 y FROM part WHERE p_partkey<=5), d AS (SELECT p_partkey, min(sqrt(pow(p_size-x,2)+pow(p_retailprice/50-y,2))) s FROM part, e WHERE p_partkey>5 GROUP BY 1)
SELECT p_partkey, round(s,6) score FROM d ORDER BY s DESC, p_partkey LIMIT 10""")
def greedy_maxmin(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 50).alias("y"))
    return rounded(S.greedy_maxmin(p.filter("p_partkey > 5"), p.filter("p_partkey <= 5"), "p_partkey", ["x", "y"], 10).select("p_partkey", "score"))


@query("""WITH f AS (SELECT event_type, min(event_id) f FROM events GROUP BY 1), r AS (SELECT event_type, dense_rank() OVER (ORDER BY f)-1 group_id FROM f) SELECT event_id, group_id FROM events JOIN r ON r.event_type=events.event_type""")
def assign_geometry_ids(spark, sf_dir):
    return rounded(S.first_seen_ids(load(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "group_id"))


@query("""
WITH t AS (SELECT s_suppkey k, [s_suppkey, s_suppkey+1, s_suppkey+2] v FROM supplier), e AS (SELECT v[1] src, v[2] dst FROM t UNION ALL SELECT v[2], v[3] FROM t UNION ALL SELECT v[3], v[1] FROM t)
SELECT src, dst FROM e UNION SELECT dst, src FROM e""")
def mesh_edge_index(spark, sf_dir):
    k = F.col("s_suppkey")
    return S.undirected_edges(load(spark, sf_dir, "supplier").select(k, F.array(k, k + 1, k + 2).alias("v")), "s_suppkey", "v")


@query("""
WITH t AS (SELECT list_sort([s_suppkey, s_suppkey+1, s_suppkey+2, s_suppkey+3]) v FROM supplier), f AS (SELECT v[1] a, v[2] b, v[3] c FROM t UNION ALL SELECT v[1], v[2], v[4] FROM t UNION ALL SELECT v[1], v[3], v[4] FROM t UNION ALL SELECT v[2], v[3], v[4] FROM t)
SELECT a, b, c FROM f GROUP BY 1,2,3 HAVING count(*)=1""")
def boundary_faces_tet(spark, sf_dir):
    k = F.col("s_suppkey")
    f = S.boundary_faces(load(spark, sf_dir, "supplier").select(F.array(k, k + 1, k + 2, k + 3).alias("v")), "v")
    return f.select(*(F.col("face")[i].alias(n) for i, n in enumerate("abc")))


@query("""
SELECT p_partkey, round(CASE WHEN p_size>25 THEN sqrt(p_retailprice) ELSE p_size*2.0 END + least(greatest(p_retailprice/100, 9), 15) + p_size % 7 - (SELECT avg(p_size) FROM part), 6) result FROM part""")
def safe_eval(spark, sf_dir):
    return rounded(expression.safe_eval(load(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), "(sqrt(p_retailprice) if p_size > 25 else p_size * 2) + clip(p_retailprice / 100, 9, 15) + p_size % 7 - mean(p_size)").select("p_partkey", "result"))


@query("""
SELECT p_partkey, round(p_size*p_retailprice/0.8,4) reynolds, round(pow(1+0.2*pow(p_size/25.0,2),3.5),6) p_ratio, round(sqrt(pow(p_size,2)+pow(p_retailprice/50,2)),6) r, round(atan2(p_retailprice/50,p_size),6) theta,
 round((p_retailprice*6894.757293168)/1e5,5) bar, round((CASE WHEN (p_size-20)*(p_size-30)<=0 THEN 0 ELSE sign(p_size-20)*least(abs(p_size-20),abs(p_size-30)) END)::double,6) minmod,
 round((sign(p_size-25)*greatest(abs(p_size-25)-3,0))::double,6) soft FROM part""")
def scalar_functions(spark, sf_dir):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return rounded(load(spark, sf_dir, "part").select(
        "p_partkey", scalars.reynolds_number(x, y, F.lit(0.8)).alias("reynolds"), scalars.isentropic_pressure_ratio(x / 25).alias("p_ratio"),
        scalars.cylindrical(x, y / 50, y)["r"].alias("r"), scalars.cylindrical(x, y / 50, y)["theta"].alias("theta"),
        scalars.convert(y, "psi", "bar").alias("bar"), scalars.minmod(x - 20, x - 30).alias("minmod"), scalars.soft_threshold(x - 25, 3.0).alias("soft"),
    ), reynolds=4, bar=5)


@query("""SELECT c_custkey, sha256(c_name) h, list_sum(list_transform(range(20), lambda i: (((c_custkey>>i)&1)<<(3*i))))::bigint morton FROM customer""")
def hashes_and_morton(spark, sf_dir):
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k, F.sha2("c_name", 256).alias("h"), scalars.morton3(k, F.lit(0), F.lit(0)).alias("morton"))


# --- Recursions ---------------------------------------------------------------------------------------------------

_SER = "a AS (SELECT user_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i FROM events)"


@query(f"""WITH RECURSIVE {_SER}, r AS (SELECT user_id, i, greatest(0,0+(x-50)/10-0.5) up, least(0,0+(x-50)/10+0.5) dn FROM a WHERE i=0
 UNION ALL SELECT a.user_id, a.i, greatest(0,up+(x-50)/10-0.5), least(0,dn+(x-50)/10+0.5) FROM r JOIN a ON a.user_id=r.user_id AND a.i=r.i+1)
SELECT user_id, i, round(up,5) up, round(dn,5) down, (up>5 OR dn<-5) alarm FROM r""")
def cusum(spark, sf_dir):
    return rounded(R.cusum(load(spark, sf_dir, "events").withColumn("z", (F.col("value") - 50) / 10), "user_id", TIME, "z"), 5)


@query(f"""WITH RECURSIVE {_SER}, s AS (SELECT user_id, stddev_pop(x) s, min(x) FILTER (WHERE i=0) x0 FROM a GROUP BY 1), r AS (SELECT user_id, i, x*1.0 z FROM a WHERE i=0
 UNION ALL SELECT a.user_id, a.i, 0.8*z+0.2*x FROM r JOIN a ON a.user_id=r.user_id AND a.i=r.i+1)
SELECT r.user_id, i, round(z,5) z, abs(z-x0)/(s+1e-30)>1.0 alarm FROM r JOIN s ON s.user_id=r.user_id""")
def ewma(spark, sf_dir):
    return rounded(R.ewma(load(spark, sf_dir, "events"), "user_id", TIME, "value", 0.2, 1.0), 5)


@query("""
WITH RECURSIVE s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v, count(*) AS n, var_pop(value) AS var FROM events GROUP BY 1 HAVING count(*) >= 10),
p AS (SELECT user_id, n, 2 * (var + 1e-30) * ln(n) AS pen, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(v[1:k]), 0.0)) AS s1, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(list_transform(v[1:k], lambda x: x * x)), 0.0)) AS s2 FROM s),
b(user_id, n, pen, s1, s2, e, best, last) AS (SELECT user_id, n, pen, s1, s2, 4::bigint, [-pen, 'inf'::double, 'inf'::double, 'inf'::double, 'inf'::double], [0::bigint, 0, 0, 0, 0] FROM p UNION ALL
  SELECT user_id, n, pen, s1, s2, e + 1, list_append(best, list_min(t)), list_append(last, list_position(t, list_min(t)) - 1) FROM (
    SELECT *, list_transform(range(0, e - 3), lambda k: best[k + 1] + s2[e + 2] - s2[k + 1] - power(s1[e + 2] - s1[k + 1], 2) / (e + 1 - k) + pen) AS t FROM b WHERE e < n)),
back(user_id, pos, last) AS (SELECT user_id, last[n + 1], last FROM b WHERE e = n UNION ALL SELECT user_id, last[pos + 1], last FROM back WHERE pos > 0)
SELECT user_id, pos AS change FROM back WHERE pos > 0""")
def change_points(spark, sf_dir):
    return rounded(R.partition_changes(load(spark, sf_dir, "events"), "user_id", TIME, "value"))


@query(f"""WITH RECURSIVE {_SER}, r AS (SELECT user_id, i, CAST(50.0 + (p/(p+25.0))*(x-50.0) AS DOUBLE) m, CAST((1-p/(p+25.0))*p AS DOUBLE) v FROM a, (SELECT 101.0 p) WHERE i=0
 UNION ALL SELECT a.user_id, a.i, m+((v+1)/(v+1+25.0))*(x-m), (1-(v+1)/(v+1+25.0))*(v+1) FROM r JOIN a ON a.user_id=r.user_id AND a.i=r.i+1)
SELECT user_id, i, round(m,5) state FROM r""")
def kalman_filter(spark, sf_dir):
    k = R.kalman(load(spark, sf_dir, "events"), "user_id", TIME, ["value"], [[1.0]], [[1.0]], [[1.0]], [[25.0]], [50.0], [[100.0]])
    return rounded(k.select("user_id", "i", F.col("state")[0].alias("state")), 5)
