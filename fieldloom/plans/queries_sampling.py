"""Registered queries of designs and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import sampling as D
from fieldloom.operators import validation as V

from .queries import SCALE, load, query, rounded

_INV = "list_sum(list_transform(range(20), lambda k: ((i // ({b}::bigint**k)::bigint) % {b}) / ({b}::double**(k+1))))"


@query(f"SELECT i, round(-1+3*{_INV.format(b=2)},8) x0, round(10*{_INV.format(b=3)},8) x1 FROM (SELECT unnest(range(1,513)) i)")
def halton_design(spark, sf_dir):
    return rounded(D.halton(spark, 512, [(-1.0, 2.0), (0.0, 10.0)]), 8)


@query("""
WITH b AS (SELECT p_brand, p_partkey, p_size*1.0 a, p_retailprice/100 c FROM part), m AS (SELECT p_brand, p_partkey, 'a' moved, ((a+0.5)*(a+0.5)*c - a*a*c)/0.5 e FROM b UNION ALL SELECT p_brand, p_partkey, 'c', (a*a*(c+0.5) - a*a*c)/0.5 FROM b)
SELECT p_brand, moved, round(avg(abs(e)),4) mu_star, round(stddev_pop(e),4) sigma FROM m GROUP BY 1,2""")
def morris_sensitivity(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 1.0).alias("a"), (F.col("p_retailprice") / 100).alias("c"))
    f = D.one_at_a_time(p, ["a", "c"], 0.5).withColumn("f", F.col("a") * F.col("a") * F.col("c"))
    base = f.filter("moved is null").select("p_partkey", F.col("f").alias("f0"))
    e = f.filter("moved is not null").join(base, "p_partkey").withColumn("e", (F.col("f") - F.col("f0")) / 0.5)
    return rounded(e.groupBy("p_brand", "moved").agg(F.avg(F.abs("e")).alias("mu_star"), F.stddev_pop("e").alias("sigma")), 4)


# The distribution function of a Poisson variable of mean 1.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


@query(f"""
WITH u AS (SELECT user_id, r, value, ('0x' || substr(md5('0-' || r || '-' || event_id), 1, 8))::bigint / 4294967296.0::double AS u FROM events, range(1, 201) AS t(r)),
w AS (SELECT user_id, r, value, {' + '.join(f'(u >= {c})::int' for c in _POISSON)} AS w FROM u),
m AS (SELECT user_id, r, sum(w * value) / greatest(sum(w), 1) AS m FROM w GROUP BY 1, 2)
SELECT user_id, round(quantile_cont(m, 0.05), 6) AS lower, round(quantile_cont(m, 0.95), 6) AS upper, (SELECT round(avg(value) * {SCALE}, 6) FROM events e WHERE e.user_id = m.user_id) AS mean FROM m GROUP BY 1""")
def bootstrap_ci(spark, sf_dir):
    found = D.bootstrap_mean(load(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return rounded(found.withColumn("mean", F.col("mean") * SCALE), 6)


@query("""
WITH x AS (SELECT p_partkey, ('0x' || substr(md5('0-' || p_partkey), 1, 8))::bigint % 5 AS fold, p_size::double AS x, p_retailprice / 100 + p_size * (p_partkey % 3) AS y FROM part),
m AS (SELECT f AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x, range(5) AS t(f) WHERE fold <> f GROUP BY 1),
e AS (SELECT x.fold, y, a + b * x AS p, avg(y) OVER (PARTITION BY x.fold) AS my FROM x JOIN m USING (fold))
SELECT fold, count(*) AS n, round(sqrt(avg(power(y - p, 2))), 6) AS rmse, round(1 - sum(power(y - p, 2)) / sum(power(y - my, 2)), 6) AS r2 FROM e GROUP BY 1""")
def kfold_scores(spark, sf_dir):
    """A line fitted on four folds and judged on the fifth."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100 + F.col("p_size") * (F.col("p_partkey") % 3)).alias("y"))
    return rounded(V.kfold_scores(p, "p_partkey", ["x"], "y", V.fit_linear, V.predict_linear, 5), 6)


@query()
def bootstrap_statistic(spark, sf_dir):
    """Intervals of the medians of events by type, by little bootstraps."""
    return rounded(V.little_bootstraps(load(spark, sf_dir, "events"), "event_type", "event_id", "value", V.weighted_median), 6)
