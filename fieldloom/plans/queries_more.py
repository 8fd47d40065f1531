"""Registered queries of predicates, probes, diagnostics, morphology, models and reduced-order operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.operators import assimilation as E
from fieldloom.operators import diagnostics as D
from fieldloom.operators import joins as J
from fieldloom.operators import morphology as M
from fieldloom.operators import probes as P
from fieldloom.operators import recursions as R
from fieldloom.operators import relations as S
from fieldloom.operators import rom
from fieldloom.operators.frames import shared_root
from fieldloom.streaming import sensors

from .queries import _GRID, SCALE, TIME, _grid, load, query, rounded, seconds

LINES = ["l_orderkey", "l_linenumber"]

# --- Predicates and relations --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber::bigint l_linenumber FROM lineitem WHERE l_quantity*l_tax>2.5")
def predicate_mask(spark, sf_dir):
    return rounded(load(spark, sf_dir, "lineitem").filter(F.col("l_quantity") * F.col("l_tax") > 2.5).select(*LINES))


@query("SELECT p_partkey FROM part WHERE abs(p_size*1.0-p_retailprice/50)>3")
def band_mask(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumns({"a": F.col("p_size") * 1.0, "b": F.col("p_retailprice") / 50})
    return p.filter(S.differs("a", "b", 3.0)).select("p_partkey")


@query("SELECT event_id FROM events WHERE abs(value-50)>40")
def threshold_detector(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("r", F.col("value") - 50).filter(S.beyond("r", 40.0)).select("event_id")


@query("""WITH a AS (SELECT event_id, coalesce(abs(lead(value) OVER w-lag(value) OVER w)/2,0) ind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(ind,6) "indicator", ind>20 refine FROM a""")
def mark_refine(spark, sf_dir):
    return rounded(S.refine(load(spark, sf_dir, "events"), "user_id", TIME, "value", 20.0).select("event_id", "indicator", "refine"))


_PROBS = "SELECT s_suppkey k, [(s_suppkey%7)/10.0e0, (s_suppkey%4)/20.0e0, 1.0e0-(s_suppkey%7)/10.0e0-(s_suppkey%4)/20.0e0] p FROM supplier"


def _probabilities(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b = k % 7 / 10.0, k % 4 / 20.0
    return load(spark, sf_dir, "supplier").select(k.alias("k"), F.array(a, b, 1.0 - a - b).alias("p"))


@query(f"WITH s AS ({_PROBS}) SELECT k, list_position(p, list_max(p))::bigint-1 AS label FROM s WHERE list_max(p)>=0.5")
def pseudo_label_filter(spark, sf_dir):
    return S.confident(_probabilities(spark, sf_dir), "p", 0.5).select("k", "label")


@query(f"WITH s AS ({_PROBS}) SELECT k, round(list_max(p),9) score FROM s ORDER BY list_max(p), k LIMIT 10")
def uncertainty_query(spark, sf_dir):
    return rounded(S.top_k(_probabilities(spark, sf_dir), F.array_max("p"), "k", 10, largest=False).select("k", "score"), 9)


@query(f"WITH s AS ({_PROBS}), m AS (SELECT k, list_reverse_sort(p)[1]-list_reverse_sort(p)[2] m FROM s) SELECT k, round(m,9) score FROM m ORDER BY m, k LIMIT 10")
def margin_query(spark, sf_dir):
    return rounded(S.top_k(_probabilities(spark, sf_dir), S.margin("p"), "k", 10, largest=False).select("k", "score"), 9)


@query("SELECT p_partkey FROM part WHERE p_retailprice/100<=12")
def select_curriculum_indices(spark, sf_dir):
    return load(spark, sf_dir, "part").withColumn("difficulty", F.col("p_retailprice") / 100).filter(S.threshold("difficulty", 12.0, "below") | (F.col("difficulty") == 12)).select("p_partkey")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i FROM events) WHERE i%3=0")
def downsample_3d(spark, sf_dir):
    return S.every_nth(load(spark, sf_dir, "events"), "user_id", TIME, 3).select("event_id")


@query("SELECT event_id, round(CASE WHEN event_type<>'error' THEN value ELSE -1 END,6) v FROM events")
def apply_validity_mask(spark, sf_dir):
    return rounded(load(spark, sf_dir, "events").select("event_id", S.masked("value", F.col("event_type") != "error", -1.0).alias("v")))


_NAMES = "['rhoU','Pressure','massFlowRate','Q','Total_Energy','velocity','heatFlux']"


@query(f"WITH f AS (SELECT p_partkey, {_NAMES}[(p_partkey%7)+1] AS name FROM part) SELECT p_partkey, name FROM f WHERE regexp_matches(lower(name),'rho|density|mass|flux|flow_rate|flowrate|momentum|total_energy|totalenergy|enthalpy_flow')")
def flag_conserved_fields(spark, sf_dir):
    names = F.array(*map(F.lit, ("rhoU", "Pressure", "massFlowRate", "Q", "Total_Energy", "velocity", "heatFlux")))
    return load(spark, sf_dir, "part").select("p_partkey", names[(F.col("p_partkey") % 7).cast("int")].alias("name")).filter(S.is_conserved("name"))


@query("""WITH t AS (SELECT s_suppkey k, unnest([s_suppkey, s_suppkey+1, s_suppkey+2]) v FROM supplier) SELECT k FROM t LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal>0) q ON q.s_suppkey=v GROUP BY k HAVING count(q.s_suppkey)=3""")
def clip_triangles(spark, sf_dir):
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    tri = s.select(k.alias("k"), F.array(k, k + 1, k + 2).alias("v"))
    return S.kept_triangles(tri, "k", "v", s.filter("s_acctbal > 0"), "s_suppkey").select("k")


@query("SELECT a.p_partkey a, b.p_partkey b FROM part a JOIN part b ON md5(a.p_brand)=md5(b.p_brand) AND md5(a.p_type||a.p_size)=md5(b.p_type||b.p_size) WHERE a.p_partkey<b.p_partkey")
def same_mesh(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.md5("p_brand").alias("t"), F.md5(F.concat("p_type", "p_size")).alias("c"))
    return S.same_mesh(p, "p_partkey", "t", "c")


@query("""WITH s AS (SELECT s_suppkey, s_acctbal/100 u, s_suppkey*0.5e0 v FROM supplier) SELECT s_suppkey, CAST(NULL AS VARCHAR) axis, round(u,6) u, round(v,6) v FROM s
UNION ALL SELECT s_suppkey, 'u', round(-u,6)+0.0, round(v,6) FROM s UNION ALL SELECT s_suppkey, 'v', round(u,6), round(-v,6)+0.0 FROM s""")
def augment_symmetric(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("u"), (F.col("s_suppkey") * 0.5).alias("v"))
    out = rounded(S.reflected(s, ["u", "v"]).select("s_suppkey", "axis", "u", "v"))
    return out.withColumns({c: F.col(c) + 0.0 for c in "uv"})  # no negative zeros


@query("SELECT event_id, round(CASE WHEN ('0x'||substr(md5('7:'||event_id),1,8))::bigint/4294967296.0<0.2 THEN 0 ELSE value END,6) v FROM events")
def random_dropout(spark, sf_dir):
    return rounded(load(spark, sf_dir, "events").select("event_id", S.dropped_out("value", "event_id", 0.2, 7).alias("v")))


@query("SELECT DISTINCT l_orderkey, l_linenumber*1.0e0 t, o_totalprice, o_orderstatus FROM lineitem JOIN orders ON o_orderkey=l_orderkey")
def expand_unsteady_case_snapshots(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderstatus")
    return S.snapshots_with_parameters(load(spark, sf_dir, "lineitem"), o, "l_orderkey", "l_linenumber")


@query("SELECT event_id, user_id FROM events WHERE event_type='error' ORDER BY event_id DESC LIMIT 50")
def run_history(spark, sf_dir):
    return S.last_runs(load(spark, sf_dir, "events").filter("event_type = 'error'"), "event_id").select("event_id", "user_id")


@query("SELECT p_partkey FROM part WHERE (p_size-10)/40.0e0*0.6+(p_retailprice/50-15)/30.0e0*0.8>=0.3")
def plane_half_space(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 10) / 40.0).alias("x"), ((F.col("p_retailprice") / 50 - 15) / 30.0).alias("y"))
    return p.filter(S.half_space(["x", "y"], (0.0, 0.375), (0.6, 0.8))).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_size*1.0 x, p_retailprice/50 y, (p_partkey%10)*1.0 z FROM part), r AS (SELECT *, ((x-5)*30+(y-18)*0+(z-1)*40)/50.0e0 t FROM p)
SELECT p_partkey FROM r WHERE t>=0 AND t<=50 AND sqrt(pow(x-5-t*0.6,2)+pow(y-18,2)+pow(z-1-t*0.8,2))<=6.25""")
def cylinder_mask(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 50).alias("y"), (F.col("p_partkey") % 10 * 1.0).alias("z"))
    return p.filter(S.cylinder(["x", "y", "z"], (5.0, 18.0, 1.0), (35.0, 18.0, 41.0), 6.25)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE abs((p_size-20)*0.6+(p_retailprice/50-20)*0.8)<1.5001")
def slice_plane_arbitrary(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 50).alias("y"))
    return p.filter(S.near_plane(["x", "y"], (20.0, 20.0), (3.0, 4.0), 1.5001)).select("p_partkey")


@query("SELECT event_id FROM events WHERE value<25")
def threshold_to_mask(spark, sf_dir):
    return load(spark, sf_dir, "events").filter(S.threshold("value", 25.0, "below")).select("event_id")


@query("""WITH f AS (SELECT p_brand, p_size f, avg(p_retailprice) a FROM part GROUP BY 1,2), p AS (SELECT *, a>coalesce(lag(a) OVER w,-1e300) AND a>coalesce(lead(a) OVER w,-1e300) pk FROM f WINDOW w AS (PARTITION BY p_brand ORDER BY f)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, f) rank FROM p WHERE pk AND f>0) SELECT p_brand, f::bigint f, round(a,5) a, rank FROM r WHERE rank<=3""")
def find_dominant_frequencies(spark, sf_dir):
    f = load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("f")).agg(F.avg("p_retailprice").alias("a"))
    return rounded(S.spectral_peaks(f, "p_brand", "f", "a", 3).select("p_brand", "f", "a", "rank"), 5)


@query("SELECT a, b FROM (SELECT unnest([1,2,3])::bigint a) CROSS JOIN (SELECT unnest(['x','y']) b)")
def grid_sweep(spark, sf_dir):
    return S.sweep(spark, {"a": [1, 2, 3], "b": ["x", "y"]})


@query("""WITH a AS (SELECT p_brand||':'||p_type p, count(*)::varchar v FROM part WHERE p_size<30 GROUP BY 1), b AS (SELECT p_brand||':'||p_type p, count(*)::varchar v FROM part WHERE p_size>20 GROUP BY 1)
SELECT coalesce(a.p,b.p) path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.p=b.p WHERE a.v IS DISTINCT FROM b.v""")
def diff_configs(spark, sf_dir):
    side = lambda c: load(spark, sf_dir, "part").filter(c).groupBy(F.concat_ws(":", "p_brand", "p_type").alias("path")).agg(F.count("*").cast("string").alias("v"))
    return S.diff_maps(side("p_size < 30"), side("p_size > 20"), "path", "v").select("path", "change", "old", "new")


# --- Scalars -------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT p_partkey, p_size*1.0e0 x, p_retailprice/50 y, (p_partkey%10)-4.5e0 z FROM part), r AS (SELECT *, sqrt(x*x+y*y+z*z) rr FROM a)
SELECT p_partkey, round(rr,6) r, round(acos(z/rr),6) theta, round(atan2(y,x),6) phi, round(cos(0.3)*x-sin(0.3)*y,6) rot_u, round(sin(0.3)*x+cos(0.3)*y,6) rot_v,
 round(0.5*z*(1+tanh(sqrt(2/pi())*(z+0.044715*z*z*z))),6) gelu, round(exp(z)/(exp(z)+exp(1.0)+exp(-2.0)),7) softmax0,
 round(CASE WHEN z*(x-25)<=0 THEN 0 ELSE 2*z*(x-25)/(z+x-25) END,6) van_leer, round(least(x,y),6) csg_union, round(greatest(x,y),6) csg_intersect, round(greatest(x,-y),6) csg_diff,
 round(2.5*pow(300+x,0.5)*exp(-5000/(8.314462618*(300+x))),7) arrhenius, round(x+2*y,6) ucb, round(x-1.96*y,6) lower, round(x+1.96*y,6) upper, round(x/greatest(y,1)/(1-0.99),4) burn,
 round(0.7*x+0.3*y,6) sync0, round(x*y/(z+10),6) strouhal, round(-x*y*z,6) nodal FROM r""")
def scalar_functions_2(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 50).alias("y"), (F.col("p_partkey") % 10 - 4.5).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    s, rot, ci = scalars.spherical(x, y, z), scalars.rotate_2d(x, y, 0.3), scalars.with_interval(x, y)
    p = p.withColumn("v", F.array(z, F.lit(1.0), F.lit(-2.0)))
    return rounded(p.select(
        "p_partkey", s["r"].alias("r"), s["theta"].alias("theta"), s["phi"].alias("phi"), rot["u"].alias("rot_u"), rot["v"].alias("rot_v"), scalars.gelu(z).alias("gelu"), scalars.softmax("v")[0].alias("softmax0"),
        scalars.van_leer(z, x - 25).alias("van_leer"), scalars.csg_union(x, y).alias("csg_union"), scalars.csg_intersect(x, y).alias("csg_intersect"), scalars.csg_difference(x, y).alias("csg_diff"),
        scalars.arrhenius(2.5, 300 + x, 5000.0, 0.5).alias("arrhenius"), scalars.upper_confidence(x, y).alias("ucb"), ci["lower"].alias("lower"), ci["upper"].alias("upper"), scalars.burn_rate(x, y, 0.99).alias("burn"),
        scalars.blend(F.array(x), F.array(y), 0.3)[0].alias("sync0"), D.strouhal(x, y, z + 10).alias("strouhal"), P.nodal_forces(x, y, [z])[0].alias("nodal"),
    ), softmax0=7, arrhenius=7, burn=4)


@query("""WITH m AS (SELECT p_partkey, [p_size-25, p_partkey%13-6, 3] q FROM part), s AS (SELECT *, list_max(list_transform(q, lambda v: abs(v)))/127.0e0 s FROM m)
SELECT p_partkey, round(s,8) scale, list_transform(q, lambda v: round_even(v/s,0)::bigint)[1] c0, list_transform(q, lambda v: round_even(v/s,0)::bigint)[2] c1 FROM s""")
def quantize_int8(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("q", F.array((F.col("p_size") - 25).cast("double"), (F.col("p_partkey") % 13 - 6).cast("double"), F.lit(3.0)))
    z = scalars.quantize_int8("q")
    return rounded(p.select("p_partkey", z["scale"].alias("scale"), z["codes"][0].cast("long").alias("c0"), z["codes"][1].cast("long").alias("c1")), 8)


@query("""WITH a AS (SELECT c_custkey, sha256('s'||c_name) h1 FROM customer) SELECT c_custkey, h1, sha256(h1||c_custkey) h2 FROM a""")
def hash_chain(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumn("m", F.array("c_name", F.col("c_custkey").cast("string")))
    return c.select("c_custkey", scalars.hash_chain("m", "s").alias("h")).select("c_custkey", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2"))


@query("SELECT c_custkey, sha256(c_name) h FROM customer")
def hash_bytes(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("h"))


@query("""SELECT s_suppkey, 'H2|O'||(s_suppkey%3) reactants, CASE WHEN s_suppkey%4=0 THEN 'OH' ELSE 'OH|H' END products, CASE WHEN s_suppkey%4=0 THEN 0 ELSE (s_suppkey%5)*1000.0e0 END a, CASE WHEN s_suppkey%4=0 THEN 0 ELSE 0.5e0 END beta, CASE WHEN s_suppkey%4=0 THEN 0 ELSE s_suppkey*1.0e0 END ea FROM supplier""")
def parse_reaction(spark, sf_dir):
    k = F.col("s_suppkey")
    rates = F.concat(F.lit("OH + H "), (k % 5).cast("string"), F.lit("e3 0.5 "), k.cast("string"))
    line = F.concat(F.lit(" H2 +O"), (k % 3).cast("string"), F.lit(" = "), F.when(k % 4 == 0, "OH").otherwise(rates))
    s = load(spark, sf_dir, "supplier").select(k, scalars.parse_reaction(line).alias("r"))
    return s.select("s_suppkey", F.array_join("r.reactants", "|").alias("reactants"), F.array_join("r.products", "|").alias("products"), "r.a", "r.beta", "r.ea")


@query(r"""SELECT s_suppkey, array_to_string(regexp_extract_all('(0 "grid") (10 (1 '||s_suppkey||')) ( '||(s_suppkey%50)||' x) (a 3)', '\(\s*(\d+)\b', 1), ',') ids FROM supplier""")
def parse_section_ids(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('(0 "grid") (10 (1 '), k, F.lit(")) ( "), (F.col("s_suppkey") % 50).cast("string"), F.lit(" x) (a 3)"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(scalars.section_ids(text).cast("array<string>"), ",").alias("ids"))


@query("SELECT s_suppkey, s_suppkey a, s_suppkey%3 b, 1::bigint c FROM supplier")
def what_if(spark, sf_dir):
    k = F.col("s_suppkey")
    m = scalars.what_if(F.create_map(F.lit("a"), k, F.lit("b"), F.lit(2).cast("long")), F.create_map(F.lit("b"), k % 3, F.lit("c"), F.lit(1).cast("long")))
    return load(spark, sf_dir, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", *(F.col("m")[c].alias(c) for c in "abc"))


@query("""SELECT event_id, CASE WHEN event_id%2=0 THEN 's'||user_id END sensor_id, event_id*1.0e0 "timestamp", round(CASE WHEN event_id%2=0 THEN value ELSE value+user_id END,6) total, (CASE WHEN event_id%2=0 THEN 1 ELSE 2 END)::bigint n FROM events""")
def decode_sensor_payload(spark, sf_dir):
    i, u, v = (F.col(c).cast("string") for c in ("event_id", "user_id", "value"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"sensor_id": "s'), u, F.lit('", "timestamp": '), i, F.lit(', "values": ['), v, F.lit("]}"))).otherwise(F.concat_ws(",", i, v, u))
    d = load(spark, sf_dir, "events").select("event_id", scalars.decode_payload(text).alias("d"))
    return rounded(d.select("event_id", "d.sensor_id", "d.timestamp", F.aggregate("d.values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("d.values").alias("n")))


_BITS = "list_sum(list_transform(range(20), lambda i: ((({v}>>i)&1)<<(3*i+{s}))))::bigint"


@query(f"SELECT c_custkey, {_BITS.format(v='c_custkey', s=0)}+{_BITS.format(v='(c_nationkey::bigint)', s=1)}+{_BITS.format(v='(c_custkey*7%1000)', s=2)} morton FROM customer")
def morton3(spark, sf_dir):
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k, scalars.morton3(k, F.col("c_nationkey"), k * 7 % 1000).alias("morton"))


@query("""WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) v FROM events GROUP BY 1), w AS (SELECT user_id, v, unnest(range(0, greatest(len(v)-5,0), 5)) s FROM a)
SELECT user_id, s//5 w, round(list_sum(v[s+1:s+4]),5) x, round(list_sum(v[s+5:s+6]),5) y FROM w""")
def make_io_pairs(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s")).withColumn("v", F.col("s.value"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    p = e.select("user_id", F.posexplode(scalars.io_pairs("v", 4, 2, 5)).alias("w", "p"))
    return rounded(p.select("user_id", "w", total("p.x").alias("x"), total("p.y").alias("y")), 5)


# --- Probes --------------------------------------------------------------------------------------------------------

_POINTS = "SELECT p_partkey pid, p_size*1.0e0 x, p_retailprice/20 y, p_retailprice v FROM part"


def _points(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 20).alias("y"), F.col("p_retailprice").alias("v"))


_NEAR = "r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, pid) rank FROM (SELECT tid, pid, v, sqrt(pow(p.x-t.x,2)+pow(p.y-t.y,2)) d FROM p, t))"


@query(f"""WITH p AS ({_POINTS}), t AS (SELECT i tid, 0.3+i/11.0e0*49.1 x, 46+i/11.0e0*50 y FROM range(12) r(i)), {_NEAR}
SELECT t.tid AS sample, round(t.x,6) x, round(t.y,6) y, round(coalesce(max(CASE WHEN rank=1 AND d<1e-12 THEN v END), sum(v/greatest(d*d,1e-30))/sum(1/greatest(d*d,1e-30))),5) "value" FROM r JOIN t ON t.tid=r.tid WHERE rank<=4 GROUP BY 1,2,3""")
def line_probe(spark, sf_dir):
    return rounded(P.line_probe(_points(spark, sf_dir), "pid", ["x", "y"], "v", (0.3, 46.0), (49.4, 96.0), 12, 2.0, "idw"), 6, value=5)


_TARGETS = "SELECT s_suppkey tid, (s_suppkey*7%50)*1.0e0+0.37 x, 45+(s_suppkey*13%60)*0.911e0 y FROM supplier"


def _targets(spark, sf_dir):
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(k.alias("tid"), (k * 7 % 50 * 1.0 + 0.37).alias("x"), (45 + k * 13 % 60 * 0.911).alias("y"))


@query(f"""WITH p AS ({_POINTS}), t AS ({_TARGETS}), {_NEAR} SELECT tid, l_linenumber::bigint t, round(l_extendedprice,4) "value" FROM r JOIN lineitem ON l_partkey=pid WHERE rank=1""")
def probe_time_series(spark, sf_dir):
    snaps = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"), F.col("l_linenumber").alias("t"), F.col("l_extendedprice").alias("value"))
    return rounded(P.probe_series(snaps, _points(spark, sf_dir), _targets(spark, sf_dir), "pid", "tid", "t", "value", ["x", "y"], 2.0), 4)


@query(f"""WITH p AS ({_POINTS}), t AS ({_TARGETS}) SELECT pid, round(min(sqrt(pow(p.x-t.x,2)+pow(p.y-t.y,2))),6) distance FROM p, t GROUP BY 1""")
def wall_distance(spark, sf_dir):
    return rounded(P.wall_distance(_points(spark, sf_dir), _targets(spark, sf_dir), "pid", "tid", ["x", "y"], 4.0))


@query("""WITH p AS (SELECT p_brand g, p_size c, avg(p_retailprice) v FROM part GROUP BY 1,2), q AS (SELECT g, i FROM (SELECT DISTINCT p_brand g FROM part), range(60) t(i)),
b AS (SELECT g, i, (SELECT max(c) FROM p WHERE p.g=q.g AND c<i) c0, (SELECT min(c) FROM p WHERE p.g=q.g AND c>=i) c1 FROM q)
SELECT b.g, b.i, round(CASE WHEN c0 IS NULL THEN p1.v WHEN c1 IS NULL THEN p0.v ELSE p0.v+(i-c0)*1.0e0/(c1-c0)*(p1.v-p0.v) END,5) "value" FROM b LEFT JOIN p p0 ON p0.g=b.g AND p0.c=c0 LEFT JOIN p p1 ON p1.g=b.g AND p1.c=c1""")
def gap_tooth_fill(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("c")).agg(F.avg("p_retailprice").alias("v"))
    return rounded(P.gap_fill(p, "g", "c", "v", 60), 5)


@query("""WITH s AS (SELECT user_id, epoch_us(ts)/1e6 t, value FROM events), e AS (SELECT user_id, min(t) a, max(t) b FROM s GROUP BY 1), g AS (SELECT user_id, c, p, a+c*300000.0+p/6*300000.0 t0 FROM e, range(60) r(c), range(6) q(p) WHERE c<floor((b-a)/300000.0)),
r AS (SELECT g.user_id, c, p, value, row_number() OVER (PARTITION BY g.user_id, c, p ORDER BY abs(t-t0), t DESC) n FROM g JOIN s ON s.user_id=g.user_id) SELECT user_id, c "cycle", p phase, round(value,6) "value" FROM r WHERE n=1""")
def cycle_extract(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    return rounded(P.cycles(e, "user_id", "t", "value", 300000.0, 6, 60))


@query("""WITH s AS (SELECT s_suppkey i, s_acctbal/100 x, 1+s_suppkey%3 m FROM supplier), p AS (SELECT a.i, b.m, abs(a.x-b.x)/1.5 q FROM s a JOIN s b ON abs(a.x-b.x)<=3)
SELECT i, round(sum(m*(CASE WHEN q<1 THEN 1-1.5*q*q+0.75*q*q*q WHEN q<2 THEN 0.25*pow(2-q,3) ELSE 0 END)*2.0/3/1.5),7) density FROM p GROUP BY 1""")
def density_1d(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 100).alias("x"), (1 + F.col("s_suppkey") % 3).alias("m"))
    return rounded(P.density_1d(s, "i", "x", "m", 1.5), 7)


@query("""WITH c AS (SELECT p_partkey k, p_size*1.0e0 x, p_retailprice/50 y, p_retailprice v, 1+p_partkey%4 w, greatest(least(round_even(p_size/5.0e0,0),10),0)::bigint*9+greatest(least(round_even((p_retailprice/50-15)/5.0e0,0),8),0)::bigint node FROM part),
h AS (SELECT node, sum(w*v)/sum(w) v FROM c GROUP BY 1), e AS (SELECT i node, 5.0e0*(i//9) x, 15+5.0e0*(i%9) y FROM range(99) r(i) WHERE i NOT IN (SELECT node FROM h)),
n AS (SELECT e.node, c.v, row_number() OVER (PARTITION BY e.node ORDER BY sqrt(pow(c.x-e.x,2)+pow(c.y-e.y,2)), k) r FROM e, c) SELECT node, round(v,5) "value" FROM h UNION ALL SELECT node, round(v,5) FROM n WHERE r=1""")
def conservative_resample_to_grid(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 50).alias("y"), F.col("p_retailprice").alias("v"), (1 + F.col("p_partkey") % 4).alias("w"))
    return rounded(P.resample_to_grid(p, ["x", "y"], "v", "w", (0.0, 15.0), 5.0, (11, 9), "k"), 5)


@query("""WITH s AS (SELECT user_id, epoch_us(ts)/1e6 t, value FROM events), e AS (SELECT user_id, min(t) a, max(t) b FROM s GROUP BY 1), q AS (SELECT user_id, j, a+j*(b-a)/7 tq FROM e, range(8) r(j)),
b AS (SELECT q.user_id, q.j, q.tq, x.t t0, x.value v0, y.t t1, y.value v1 FROM q ASOF LEFT JOIN s x ON x.user_id=q.user_id AND q.tq>x.t ASOF LEFT JOIN s y ON y.user_id=q.user_id AND q.tq<=y.t)
SELECT user_id, j, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0+(tq-t0)/(t1-t0)*(v1-v0) END,4) "value" FROM b""")
def resample_uniform(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    return rounded(J.resample_uniform(e, "user_id", "t", "value", 8).select("user_id", "j", "value"), 4)


@query("""WITH t AS (SELECT s_suppkey k, (s_suppkey*7%50)*1.0e0 ax, 18+(s_suppkey*3%20)*1.0e0 ay, (s_suppkey*7%50)+6.0e0 bx, 18+(s_suppkey*3%20)+1.0e0 "by", (s_suppkey*7%50)+2.0e0 cx, 18+(s_suppkey*3%20)+5.0e0 cy FROM supplier),
p AS (SELECT p_partkey pid, p_size+0.123e0 x, p_retailprice/50 y FROM part), s AS (SELECT pid, k, (bx-ax)*(y-ay)-("by"-ay)*(x-ax) u, (cx-bx)*(y-"by")-(cy-"by")*(x-bx) v, (ax-cx)*(y-cy)-(ay-cy)*(x-cx) w FROM p, t),
h AS (SELECT pid, min(k) k FROM s WHERE (u>=-1e-12 AND v>=-1e-12 AND w>=-1e-12) OR (u<=1e-12 AND v<=1e-12 AND w<=1e-12) GROUP BY 1) SELECT p.pid, coalesce(h.k,-1) k FROM p LEFT JOIN h ON h.pid=p.pid""")
def locate_triangle(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = k * 7 % 50 * 1.0, 18 + k * 3 % 20 * 1.0
    t = load(spark, sf_dir, "supplier").select(k.alias("k"), x.alias("ax"), y.alias("ay"), (x + 6).alias("bx"), (y + 1).alias("by"), (x + 2).alias("cx"), (y + 5).alias("cy"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") + 0.123).alias("x"), (F.col("p_retailprice") / 50).alias("y"))
    return rounded(J.locate_triangles(p, t, "pid", "k", 5.0))


# --- Diagnostics ---------------------------------------------------------------------------------------------------


def _phi(z: str) -> str:
    """SQL: the normal distribution function, by the approximation of scalars.normal_cdf."""
    t = f"(1/(1+0.3275911*abs({z})/sqrt(2)))"
    return f"(0.5*(1+sign({z})*(1-({t}*(0.254829592+{t}*(-0.284496736+{t}*(1.421413741+{t}*(-1.453152027+{t}*1.061405429)))))*exp(-({z})*({z})/2))))"


def _quantile(p: str) -> str:
    """SQL: the normal quantile by a rational approximation; its coefficients are fixed values, written out here once more."""
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def horner(c, x):
        out = "0.0e0"
        for k in c:
            out = f"({out}*{x}+({k!r}))"
        return out

    low = lambda q: f"({horner(c, q)}/{horner(d, q)})"
    q = f"({p}-0.5)"
    middle = f"({horner(a, f'({q}*{q})')}*{q}/{horner(b, f'({q}*{q})')})"
    return f"(CASE WHEN {p}<0.02425 THEN {low(f'sqrt(-2*ln({p}))')} WHEN {p}>1-0.02425 THEN -{low(f'sqrt(-2*ln(1-{p}))')} ELSE {middle} END)"


def _ks_p(d: str, n: str) -> str:
    lam = f"((sqrt({n})+0.12+0.11/sqrt({n}))*{d})"
    return f"(CASE WHEN {d}<=0 OR {lam}<0.18 THEN 1.0 ELSE greatest(least(2*list_sum(list_transform(range(1,101), lambda k: (CASE WHEN k%2=1 THEN 1.0 ELSE -1.0 END)*exp(-2.0*k*k*{lam}*{lam}))),1.0),0.0) END)"


@query(f"""WITH a AS (SELECT o_orderpriority g, o_orderkey k, o_totalprice/1000 x FROM orders), b AS (SELECT *, count(*) OVER w n, avg(x) OVER w m, stddev_samp(x) OVER w s, min(x) OVER w lo, max(x) OVER w hi, row_number() OVER (PARTITION BY g ORDER BY x, k) i, row_number() OVER (PARTITION BY g ORDER BY k) f FROM a WINDOW w AS (PARTITION BY g)),
c AS (SELECT *, {_phi('((x-m)/s)')} p, least(floor((x-lo)/(hi-lo)*5),4) bin FROM b), d AS (SELECT *, greatest(least(p,1-1e-12),1e-12) q FROM c),
e AS (SELECT g, count(*) n, max(greatest(i/n-p, p-(i-1)/n)) ks, sum((2*i-1)*ln(q)+(2*(n-i)+1)*ln(1-q)) t, {'+'.join(f'pow(count(*) FILTER (WHERE bin={i})-count(*)/5.0,2)/(count(*)/5.0)' for i in range(5))} chi FROM d GROUP BY 1),
h AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x, k) j, count(*) OVER (PARTITION BY g) c FROM b WHERE f<=50), r AS (SELECT g, x, {_quantile('((j-0.375)/(c+0.25))')} z FROM h), w AS (SELECT g, pow(sum(z*x),2)/sum(z*z)/(var_pop(x)*count(*)) w FROM r GROUP BY 1)
SELECT e.g, n, round(ks,6) ks_d, round({_ks_p('ks', 'n')},6) ks_p, round((-n-t/n)*(1+0.75/n+2.25/(n*n)),4) anderson_a2, round(chi,6) chi_square, 4::bigint chi_square_dof, round(w,6) shapiro_w FROM e JOIN w ON w.g=e.g""")
def gof_normality(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x"))
    return rounded(D.normality(o, "g", "k", "x"), 6, anderson_a2=4)


@query("""WITH a AS (SELECT l_returnflag g, count(*) o, 10.0e0+l_linenumber e FROM lineitem GROUP BY l_returnflag, l_linenumber) SELECT g, round(sum(pow(o-e,2)/e),4) chi_square, greatest(count(*)-1,1) dof FROM a GROUP BY 1""")
def chi_square_test(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_linenumber").agg(F.count("*").alias("o")).withColumn("e", 10.0 + F.col("l_linenumber"))
    return rounded(D.chi_square(d, "g", "o", "e"), 4)


@query(f"""WITH a AS (SELECT 'all' g, o_totalprice x, o_custkey%2=0 f FROM orders), v AS (SELECT x, count(*) FILTER (WHERE f) a, count(*) FILTER (WHERE NOT f) b FROM a GROUP BY 1), g AS (SELECT abs(sum(a) OVER w/sum(a) OVER ()-sum(b) OVER w/sum(b) OVER ()) d FROM v WINDOW w AS (ORDER BY x)),
m AS (SELECT max(d) d, (SELECT count(*) FILTER (WHERE f)*(count(*) FILTER (WHERE NOT f))/count(*) FROM a) n FROM g) SELECT round(d,6) ks, round({_ks_p('d', 'n')},6) p FROM m""")
def ks_test_two_sample(spark, sf_dir):
    from fieldloom.operators import aggregates as A

    o = load(spark, sf_dir, "orders").select(F.lit("all").alias("g"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 2 == 0).alias("f"))
    n = o.agg((F.count_if("f") * F.count_if(~F.col("f")) / F.count("*")).alias("n"))
    d = A.ks_statistic(o, "g", "x", F.col("f")).crossJoin(F.broadcast(n))
    return rounded(d.select("ks", D.kolmogorov_p(F.col("ks"), F.col("n")).alias("p")))


_SER = "a AS (SELECT user_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i FROM events), n AS (SELECT user_id, count(*) n, avg(x) m, var_pop(x) v, stddev_pop(x) sd FROM a GROUP BY 1)"


@query(f"""WITH {_SER}, l AS (SELECT a.user_id, n, b.i-a.i lag, sum((a.x-m)*(b.x-m))/(n-(b.i-a.i))/(any_value(v)+1e-30) rho FROM a JOIN a b ON b.user_id=a.user_id AND b.i>a.i JOIN n ON n.user_id=a.user_id WHERE b.i-a.i<=n//4 GROUP BY 1,2,3),
f AS (SELECT n.user_id, n.n, coalesce((SELECT min(lag) FROM l WHERE l.user_id=n.user_id AND rho<0),100000) s FROM n), t AS (SELECT f.user_id, f.n, greatest(1+2*coalesce((SELECT sum(rho) FROM l WHERE l.user_id=f.user_id AND lag<s),0),1) tau FROM f)
SELECT user_id, round(n/tau,5) effective, round(tau,6) correlation_time FROM t""")
def stat_convergence(spark, sf_dir):
    return rounded(D.effective_samples(load(spark, sf_dir, "events"), "user_id", TIME, "value"), 6, effective=5)


@query(f"""WITH {_SER}, w AS (SELECT a.user_id, n, i, x*(0.5-0.5*cos(2*pi()*i/(n-1))) y FROM a JOIN n ON n.user_id=a.user_id), k AS (SELECT user_id, n, k, pow(sum(y*cos(2*pi()*k*i/n)),2)+pow(sum(y*sin(2*pi()*k*i/n)),2) p FROM w, range(1,60) r(k) WHERE k<=n//2 GROUP BY 1,2,3),
e AS (SELECT user_id, ln(k*1.0e0/n) lk, ln(p/(n*n)*(CASE WHEN k<n//2 THEN 2 ELSE 1 END)) le FROM k WHERE p>0) SELECT user_id, round(regr_slope(le,lk),4) slope, round(regr_r2(le,lk),4) r2 FROM e GROUP BY 1""")
def kolmogorov_slope(spark, sf_dir):
    return rounded(D.power_law(D.energy_spectrum(load(spark, sf_dir, "events"), "user_id", TIME, "value"), "user_id"), 4)


@query(f"""WITH {_SER}, w AS (SELECT user_id, n, least(32,n) m FROM n), s AS (SELECT user_id, m, unnest(range(0, n-m+1, greatest(1,m-m//2))) s FROM w), p AS (SELECT s.user_id, m, s, i-s j, x-avg(x) OVER (PARTITION BY s.user_id, s) x FROM s JOIN a ON a.user_id=s.user_id AND i>=s AND i<s+m),
y AS (SELECT *, 0.5*(1-cos(2*pi()*j/(m-1))) h FROM p), k AS (SELECT user_id, m, s, k, (pow(sum(x*h*cos(2*pi()*k*j/m)),2)+pow(sum(x*h*sin(2*pi()*k*j/m)),2))/(sum(h*h)+1e-30) p FROM y, range(0,17) r(k) WHERE k<=m//2 GROUP BY 1,2,3,4)
SELECT user_id, round(k*1.0e0/m,6) frequency, round(avg(p)*(CASE WHEN k>0 AND k<m//2 THEN 2 ELSE 1 END),5) psd FROM k GROUP BY user_id, k, m""")
def psd_welch(spark, sf_dir):
    return rounded(R.welch(load(spark, sf_dir, "events"), "user_id", TIME, "value", 1.0, 32), 6, psd=5)


@query(f"""WITH {_SER}, q AS (SELECT unnest([0,1,2,3,4]) j, unnest([-1.0e0,0.25,1.5,0.25,-1.0])/sqrt((1+0.0625+2.25+0.0625+1)/5) z), s AS (SELECT a.user_id, a.i, avg(b.x) m, stddev_pop(b.x) sd, count(*) c FROM a JOIN a b ON b.user_id=a.user_id AND b.i>=a.i AND b.i<a.i+5 GROUP BY 1,2 HAVING count(*)=5),
d AS (SELECT s.user_id, s.i, sum(pow((b.x-m)/greatest(sd,1e-12)-z,2)) d FROM s JOIN a b ON b.user_id=s.user_id AND b.i>=s.i AND b.i<s.i+5 JOIN q ON q.j=b.i-s.i GROUP BY 1,2) SELECT user_id, i, round(sqrt(greatest(d,0)),4) distance FROM d""")
def mass_search(spark, sf_dir):
    return rounded(R.motif_profile(load(spark, sf_dir, "events"), "user_id", TIME, "value", [10.0, 50.0, 90.0, 50.0, 10.0]), 4)


@query(f"""WITH {_SER}, s AS (SELECT a.user_id, a.i, avg(b.x) m, stddev_pop(b.x) sd FROM a JOIN a b ON b.user_id=a.user_id AND b.i>=a.i AND b.i<a.i+8 GROUP BY 1,2 HAVING count(*)=8),
d AS (SELECT s.user_id, s.i a, t.i b, 2*(8-sum((x.x-s.m)/(s.sd+1e-12)*(y.x-t.m)/(t.sd+1e-12))) d FROM s JOIN s t ON t.user_id=s.user_id AND t.i>s.i+4 JOIN a x ON x.user_id=s.user_id AND x.i>=s.i AND x.i<s.i+8 JOIN a y ON y.user_id=s.user_id AND y.i-t.i=x.i-s.i GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, a, b) n FROM d) SELECT user_id, a, b, round(sqrt(greatest(d,0)),5) distance FROM r WHERE n=1""")
def find_motifs(spark, sf_dir):
    return rounded(D.motifs(load(spark, sf_dir, "events"), "user_id", TIME, "value", 8), 5)


@query("""WITH RECURSIVE a AS (SELECT user_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, greatest(10, count(*) OVER (PARTITION BY user_id)//4) r FROM events), s AS (SELECT user_id, avg(x) m, stddev_pop(x)+1e-12 sd FROM a WHERE i<r GROUP BY 1),
z AS (SELECT a.user_id, i, (x-m)/sd z FROM a JOIN s ON s.user_id=a.user_id), c AS (SELECT user_id, i, greatest(0,z-0.5) up, least(0,z+0.5) dn FROM z WHERE i=0 UNION ALL SELECT z.user_id, z.i, greatest(0,up+z-0.5), least(0,dn+z+0.5) FROM c JOIN z ON z.user_id=c.user_id AND z.i=c.i+1)
SELECT user_id, coalesce(min(i) FILTER (WHERE up>3 OR dn<-3),-1) first_alarm FROM c GROUP BY 1""")
def cusum_detect(spark, sf_dir):
    return rounded(R.first_alarm(load(spark, sf_dir, "events"), "user_id", TIME, "value"))


_B = "SELECT l_returnflag||l_linestatus g, covar_pop(u,u) uu, covar_pop(u,v) uv, covar_pop(u,w) uw, covar_pop(v,v) vv, covar_pop(v,w) vw, covar_pop(w,w) ww FROM (SELECT *, l_quantity u, l_discount*100 v, l_tax*100 w FROM lineitem) GROUP BY 1"


@query(f"""WITH r AS ({_B}), b AS (SELECT g, uu/(uu+vv+ww)-1/3.0e0 a, uv/(uu+vv+ww) b, uw/(uu+vv+ww) c, vv/(uu+vv+ww)-1/3.0e0 d, vw/(uu+vv+ww) e, ww/(uu+vv+ww)-1/3.0e0 f FROM r),
i AS (SELECT g, a*a+d*d+f*f+2*(b*b+c*c+e*e) two, 3*(a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c)) three FROM b), x AS (SELECT *, sqrt(two/6) eta, sign(three)*cbrt(abs(three/6)) xi FROM i)
SELECT g, round(two,6) "II", round(three,6) "III", round(eta,6) eta, round(xi,6) xi, CASE WHEN eta<0.05 THEN 'isotropic' WHEN eta>0.3 THEN '1_component' WHEN abs(xi)>0.2 THEN '2_component' WHEN xi>0.05 THEN 'axisymmetric_expansion' WHEN xi<-0.05 THEN 'axisymmetric_contraction' ELSE 'intermediate' END state, eta<=1/3.0e0+1e-6 AND abs(xi)<=1/3.0e0+1e-6 realizable FROM x""")
def anisotropy_state(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"), (F.col("l_tax") * 100).alias("w"))
    names = ["uu", "uv", "uw", "vv", "vw", "ww"]
    return rounded(D.anisotropy(d.groupBy("g").agg(*(F.covar_pop(*n).alias(n) for n in names)), names).select("g", "II", "III", "eta", "xi", "state", "realizable"))


def _bilinear(w: str) -> str:
    return f"((1-x)*(1-y)*{w}a+x*(1-y)*{w}b+x*y*{w}c+(1-x)*y*{w}d)"


def _slope(w: str, along: str) -> str:
    return f"((1-y)*({w}b-{w}a)+y*({w}c-{w}d))" if along == "x" else f"((1-x)*({w}d-{w}a)+x*({w}c-{w}b))"


_J = f"({_slope('u', 'x')}*{_slope('v', 'y')}-{_slope('u', 'y')}*{_slope('v', 'x')})"


@query(f"""WITH RECURSIVE g AS (SELECT c, i, j, f-avg(f) OVER (PARTITION BY c) u, g-avg(g) OVER (PARTITION BY c) v FROM ({_GRID})),
q AS (SELECT a.c, a.i, a.j, a.u ua, b.u ub, k.u uc, d.u ud, a.v va, b.v vb, k.v vc, d.v vd FROM g a JOIN g b ON b.c=a.c AND b.i=a.i+1 AND b.j=a.j JOIN g k ON k.c=a.c AND k.i=a.i+1 AND k.j=a.j+1 JOIN g d ON d.c=a.c AND d.i=a.i AND d.j=a.j+1),
s AS (SELECT * FROM q WHERE least(ua,ub,uc,ud)*greatest(ua,ub,uc,ud)<=1e-12 AND least(va,vb,vc,vd)*greatest(va,vb,vc,vd)<=1e-12),
n AS (SELECT *, 0.5e0 x, 0.5e0 y, 0 t, false stop FROM s UNION ALL SELECT c, i, j, ua, ub, uc, ud, va, vb, vc, vd, CASE WHEN h THEN x ELSE nx END, CASE WHEN h THEN y ELSE ny END, t+1, h OR NOT (nx BETWEEN 0 AND 1 AND ny BETWEEN 0 AND 1)
 FROM (SELECT *, stop OR (abs({_bilinear('u')})<1e-6 AND abs({_bilinear('v')})<1e-6) OR abs({_J})<1e-30 h, x-({_slope('v', 'y')}*{_bilinear('u')}-{_slope('u', 'y')}*{_bilinear('v')})/(CASE WHEN abs({_J})<1e-30 THEN 1 ELSE {_J} END) nx, y-({_slope('u', 'x')}*{_bilinear('v')}-{_slope('v', 'x')}*{_bilinear('u')})/(CASE WHEN abs({_J})<1e-30 THEN 1 ELSE {_J} END) ny FROM n WHERE t<20)),
e AS (SELECT c, i, j, i+x px, j+y py, {_slope('u', 'x')}+{_slope('v', 'y')} tr, {_J} det FROM n WHERE t=20 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND abs({_bilinear('u')})<=1e-5 AND abs({_bilinear('v')})<=1e-5)
SELECT c, i, j, round(px,5) x, round(py,5) y, CASE WHEN tr*tr/4-det<0 THEN (CASE WHEN tr>0 THEN 'spiral_source' ELSE 'spiral_sink' END) WHEN det<0 THEN 'saddle' WHEN tr>0 THEN 'source' ELSE 'sink' END kind FROM e""")
def critical_points(spark, sf_dir):
    g = _grid(spark, sf_dir)
    mean = g.groupBy("c").agg(F.avg("f").alias("mf"), F.avg("g").alias("mg"))
    g = g.join(F.broadcast(mean), "c").select("c", "i", "j", (F.col("f") - F.col("mf")).alias("u"), (F.col("g") - F.col("mg")).alias("v"))
    return rounded(D.critical_points(g, "c", "i", "j", "u", "v"), 5)


# --- Models --------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice)/10 bic FROM part GROUP BY 1), r AS (SELECT p_brand, exp(-0.5*(bic-(SELECT min(bic) FROM m))) w FROM m) SELECT p_brand, round(w/(SELECT sum(w) FROM r),8) weight FROM r""")
def bic_model_average(spark, sf_dir):
    m = load(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 10).alias("bic"))
    return rounded(D.bic_weights(m).select("p_brand", "weight"), 8)


@query(f"""WITH m AS (SELECT p_brand, avg(p_retailprice)/10 bic FROM part GROUP BY 1), w AS (SELECT p_brand, exp(-0.5*(bic-(SELECT min(bic) FROM m))) w FROM m),
p AS (SELECT p_size, p_brand, avg(p_retailprice)*{SCALE} x FROM part GROUP BY 1, 2), s AS (SELECT p_size, sum(w) w, sum(w*x) p, sum(w*x*x) q FROM p JOIN w USING (p_brand) GROUP BY 1)
SELECT p_size, round(p/w,6) average, round(greatest(q/w-(p/w)*(p/w),0),3) variance FROM s""")
def bic_average(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    models = p.groupBy("p_brand").agg((F.avg("p_retailprice") / 10).alias("bic"))
    each = p.groupBy("p_size", "p_brand").agg((F.avg("p_retailprice") * SCALE).alias("x"))
    return rounded(D.bic_model_average(each, models, "p_size", "p_brand", "x")[1], 6, variance=3)


@query(f"""WITH d AS (SELECT *, l_quantity*{SCALE} x FROM lineitem), m AS (SELECT l_orderkey, sum(l_linenumber) w, sum(l_linenumber*x) p, sum(l_linenumber*x*x) q FROM d GROUP BY 1) SELECT l_orderkey, round(p/w,6) average, round(greatest(q/w-(p/w)*(p/w),0),5) variance FROM m""")
def ensemble_variance(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") * SCALE)
    return rounded(D.ensemble(d, "l_orderkey", "x", "l_linenumber"), 6, variance=5)


@query("""WITH d AS (SELECT l_quantity a, l_discount*100+1 b, l_extendedprice/1000 y FROM lineitem), g AS (SELECT sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*y) ay, sum(b*y) "by" FROM d),
w AS (SELECT greatest((bb*ay-ab*"by")/(aa*bb-ab*ab),0) a, greatest((aa*"by"-ab*ay)/(aa*bb-ab*ab),0) b FROM g) SELECT 'a' AS model, round(a/(a+b),7) weight FROM w UNION ALL SELECT 'b', round(b/(a+b),7) FROM w""")
def stacking(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100 + 1).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))
    w = D.stacking(d, ["a", "b"], "y")
    return rounded(spark.createDataFrame([(m, float(x)) for m, x in zip("ab", w)], "model string, weight double"), 7)


_MOVED = "row_number() OVER (PARTITION BY r, bucket ORDER BY md5(r::varchar||':'||k)) f"


@query(f"""WITH d AS (SELECT p_partkey k, p_size*1.0e0 a, p_retailprice/100 c, 2*p_size+p_retailprice/100+(p_partkey%5) y, ('0x'||substr(md5('bucket:'||p_partkey),1,4))::bigint%64 bucket FROM part), b AS (SELECT sqrt(avg(pow(y-(2*a+c),2))) b FROM d),
m AS (SELECT d.*, r, row_number() OVER (PARTITION BY r, bucket ORDER BY k) t, {_MOVED} FROM d, range(3) q(r)), j AS (SELECT m.r, m.y, m.a, m.c, s.a sa, s.c sc FROM m JOIN m s ON s.r=m.r AND s.bucket=m.bucket AND s.f=m.t),
e AS (SELECT r, sqrt(avg(pow(y-(2*sa+c),2))) a, sqrt(avg(pow(y-(2*a+sc),2))) c FROM j GROUP BY 1) SELECT 'a' AS input, round(avg(a-b),5) importance FROM e, b UNION ALL SELECT 'c', round(avg(c-b),5) FROM e, b""")
def permutation_importance(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 1.0).alias("a"), (F.col("p_retailprice") / 100).alias("c"))
    p = p.withColumn("y", 2 * F.col("a") + F.col("c") + F.col("k") % 5)
    return rounded(D.permutation_importance(p, "k", ["a", "c"], "y", lambda x: 2 * x["a"] + x["c"], repeats=3), 5)


@query("SELECT p_partkey, round(2.0e0*p_size+3*p_retailprice+1,5) prediction, p_size=13 failed FROM part WHERE p_size<>13 UNION ALL SELECT p_partkey, NULL, true FROM part WHERE p_size=13")
def batch_predict(spark, sf_dir):
    def model(x: np.ndarray) -> np.ndarray:
        if (x[:, 0] == 13).any():
            raise ValueError("no prediction for 13")
        return x @ np.array([2.0, 3.0]) + 1

    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(D.batch_predict(p, ["p_size", "p_retailprice"], model, 64).select("p_partkey", "prediction", "failed"), 5)


@query("""WITH RECURSIVE n AS (SELECT c_nationkey k, round(avg(c_acctbal),4) a, round(avg(c_custkey%97),4) b FROM customer GROUP BY 1), d AS (SELECT p.k p, q.k q FROM n p JOIN n q ON p.a<=q.a AND p.b<=q.b AND (p.a<q.a OR p.b<q.b)),
r AS (SELECT k, 0::bigint f FROM n UNION SELECT d.q, f+1 FROM r JOIN d ON d.p=r.k) SELECT k::bigint k, max(f) front FROM r GROUP BY 1""")
def nondominated_sort(spark, sf_dir):
    n = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("a"), F.round(F.avg(F.col("c_custkey") % 97), 4).alias("b"))
    return rounded(D.nondominated_fronts(n, ["a", "b"]).select("k", "front"))


@query("SELECT l_partkey, round(var_pop(l_extendedprice/1000),4) disagreement FROM lineitem GROUP BY 1 ORDER BY var_pop(l_extendedprice/1000) DESC, l_partkey LIMIT 10")
def query_by_committee(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return rounded(D.committee(d, "l_partkey", "p", 10), 4)


@query("""WITH a AS (SELECT l_returnflag, l_quantity*sqrt(l_extendedprice) y FROM lineitem) SELECT l_returnflag, round(avg(y),4) mean, round(stddev_pop(y),4) std, round(quantile_cont(y,0.05),4) p5, round(quantile_cont(y,0.5),4) p50, round(quantile_cont(y,0.95),4) p95 FROM a GROUP BY 1""")
def propagate_mc(spark, sf_dir):
    return rounded(D.propagate(load(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity") * F.sqrt("l_extendedprice")), 4)


@query("SELECT l_linenumber::bigint l_linenumber, round(sqrt(avg(pow(l_extendedprice/1000-l_quantity,2))),5) rmse FROM lineitem GROUP BY 1")
def channel_rmse(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").withColumn("t", F.col("l_extendedprice") / 1000)
    return rounded(D.channel_rmse(d, "l_linenumber", "t", "l_quantity"), 5)


@query("""WITH c AS (SELECT l_suppkey%10 c, sqrt(avg(pow(l_extendedprice/1000-l_quantity,2))) r FROM lineitem GROUP BY 1) SELECT c, round(r,5) rmse FROM c ORDER BY r DESC, c LIMIT 3""")
def top_k_worst_channels(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("c"), (F.col("l_extendedprice") / 1000).alias("t"), "l_quantity")
    return rounded(S.top_k(D.channel_rmse(d, "c", "t", "l_quantity"), F.col("rmse"), "c", 3).select("c", "rmse"), 5)


# --- Reduced-order models ------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey k, p_size*1.0e0 a, p_retailprice/100 c FROM part), t AS (SELECT avg(a) ma, avg(c) mc, stddev_pop(a) sa, stddev_pop(c) sc, var_samp(a)+1e-12 va, var_samp(c)+1e-12 vc, covar_samp(a,c) ac, min(a) la, max(a) ha, min(c) lc, max(c) hc FROM p WHERE k%3=0 AND a BETWEEN 5 AND 45)
SELECT k, round(greatest(abs(a-ma)/sa, abs(c-mc)/sc),5) max_z, round(sqrt(greatest((vc*pow(a-ma,2)-2*ac*(a-ma)*(c-mc)+va*pow(c-mc,2))/(va*vc-ac*ac),0)),5) mahalanobis, (CASE WHEN a<la OR a>ha THEN 1 ELSE 0 END+CASE WHEN c<lc OR c>hc THEN 1 ELSE 0 END)::bigint outside FROM p, t""")
def rom_envelope(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 1.0).alias("a"), (F.col("p_retailprice") / 100).alias("c"))
    return rounded(rom.envelope(p.filter("k % 3 = 0 AND a BETWEEN 5 AND 45"), p, ["a", "c"]).select("k", "max_z", "mahalanobis", "outside"), 5)


@query("SELECT round(acos(abs(sum(p_size*p_retailprice))/sqrt(sum(1.0e0*p_size*p_size)*sum(p_retailprice*p_retailprice))),6) angle FROM part")
def subspace_drift(spark, sf_dir):
    p = load(spark, sf_dir, "part").select((F.col("p_size") * 1.0).alias("a"), F.col("p_retailprice").alias("c"))
    return rounded(spark.createDataFrame([(float(x),) for x in rom.subspace_drift(p, ["a"], ["c"])], "angle double"))


@query("""WITH p AS (SELECT p_partkey k, p_size/10.0e0 a, p_retailprice/1000 c, 3*p_size/10.0e0-p_retailprice/1000+(p_partkey%7)*0.1e0 v FROM part), g AS (SELECT sum(a*a) aa, sum(a*c) ac, sum(c*c) cc, sum(a*v) av, sum(c*v) cv FROM p WHERE k%3=0), w AS (SELECT (cc*av-ac*cv)/(aa*cc-ac*ac) x, (aa*cv-ac*av)/(aa*cc-ac*ac) y FROM g)
SELECT k, round(a*x+c*y,6) reconstructed FROM p, w""")
def gappy_reconstruct(spark, sf_dir):
    k, s, r = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    p = load(spark, sf_dir, "part").select(k.alias("k"), (s / 10.0).alias("a"), (r / 1000).alias("c"), (3 * s / 10.0 - r / 1000 + k % 7 * 0.1).alias("v"))
    return rounded(rom.gappy_reconstruct(p, ["a", "c"], "v", "k % 3 = 0").select("k", "reconstructed"))


def _modes(spark, sf_dir):
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") % 5).cast("int").alias("mode"), F.col("p_partkey").alias("point"), (F.col("p_size") / 10.0).alias("phi"))
    return p, p.groupBy("mode").agg(F.sum("phi").alias("sigma"))


@query("""WITH m AS (SELECT (p_partkey%5)::bigint m, sum(p_size/10.0e0) s, sqrt(sum(pow(p_size/10.0e0,2))) n FROM part GROUP BY 1) SELECT m "mode", round(s,5) singular_value, round(s*s/(SELECT sum(s*s) FROM m),8) energy_fraction, round(n,6) spatial_norm FROM m""")
def mode_summary(spark, sf_dir):
    return rounded(rom.mode_summary(*_modes(spark, sf_dir)), 6, singular_value=5, energy_fraction=8)


@query("""SELECT (p_partkey%5)::bigint "mode", p_partkey point, round(p_size/10.0e0,6) phi FROM part WHERE p_partkey%5<2""")
def load_rom(spark, sf_dir):
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/rom-{uuid.uuid4().hex}"
    rom.save_modes(*_modes(spark, sf_dir), path)
    return rounded(rom.load_modes(spark, path)[0].filter("mode < 2").select("mode", "point", "phi"))


@query("""
WITH g AS (SELECT (p_partkey // 20) % 2 AS c, p_partkey % 4 AS i, (p_partkey // 4) % 5 AS j, avg(p_retailprice) / 100 AS f, avg(p_size) AS g FROM part GROUP BY 1, 2, 3),
w AS (SELECT p, q, CASE WHEN p < 2 THEN p ELSE p - 4 END AS ky, CASE WHEN q < 3 THEN q ELSE q - 5 END AS kx FROM range(4) AS a(p), range(5) AS b(q)),
h AS (SELECT c, p, q, kx, ky, greatest(kx * kx + ky * ky, 1) AS k2, sum(f * cos(t)) AS ur, -sum(f * sin(t)) AS ui, sum(g * cos(t)) AS vr, -sum(g * sin(t)) AS vi FROM (SELECT *, 2 * pi() * (p * i / 4.0::double + q * j / 5.0::double) AS t FROM g, w) GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT *, (kx * ur + ky * vr) / k2 AS ar, (kx * ui + ky * vi) / k2 AS ai, (p = 0 AND q = 0) AS mean FROM h),
r AS (SELECT *, CASE WHEN mean THEN ur ELSE kx * ar END AS iur, CASE WHEN mean THEN ui ELSE kx * ai END AS iui, CASE WHEN mean THEN vr ELSE ky * ar END AS ivr, CASE WHEN mean THEN vi ELSE ky * ai END AS ivi FROM l),
o AS (SELECT g.c, g.i, g.j, g.f, g.g, sum(iur * cos(t) - iui * sin(t)) / 20 AS iu, sum(ivr * cos(t) - ivi * sin(t)) / 20 AS iv FROM (SELECT *, 2 * pi() * (p * i / 4.0::double + q * j / 5.0::double) AS t FROM g JOIN r USING (c)) AS g GROUP BY 1, 2, 3, 4, 5)
SELECT c, i, j, round(f - iu, 6) AS solenoidal_u, round(g - iv, 6) AS solenoidal_v, round(iu, 6) AS irrotational_u, round(iv, 6) AS irrotational_v FROM o""")
def helmholtz_decomp(spark, sf_dir):
    k = F.col("p_partkey")
    g = load(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 20 % 2").alias("c"), (k % 4).alias("i"), F.expr("p_partkey div 4 % 5").alias("j"))
    return rounded(D.helmholtz(g.agg((F.avg("p_retailprice") / 100).alias("f"), F.avg("p_size").alias("g")), "c", "i", "j", "f", "g"))


# --- Assimilation and streams --------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_brand g, p_partkey k, p_size*1.0e0 a, p_retailprice/100 b, ((p_partkey%7)-3)*0.1e0 e FROM part), h AS (SELECT *, a+0.5*b hx FROM p), c AS (SELECT g, covar_samp(a,hx)/(var_samp(hx)+4) ga, covar_samp(b,hx)/(var_samp(hx)+4) gb FROM h GROUP BY 1)
SELECT k, round(a+ga*(30+e-hx),5) a, round(b+gb*(30+e-hx),5) b FROM h JOIN c ON c.g=h.g""")
def enkf(spark, sf_dir):
    k = F.col("p_partkey")
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), k.alias("k"), (F.col("p_size") * 1.0).alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    out = E.enkf_update(p, "g", ["a", "b"], F.col("a") + 0.5 * F.col("b"), F.lit(30.0), 4.0, (F.col("k") % 7 - 3) * 0.1)
    return rounded(out.select("k", "a", "b"), 5)


@query("""WITH p AS (SELECT p_brand g, p_partkey k, exp(-0.5*pow(25-p_size,2)/90) raw FROM part), w AS (SELECT g, k, raw/sum(raw) OVER (PARTITION BY g) w, count(*) OVER (PARTITION BY g) n FROM p),
s AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY k ROWS UNBOUNDED PRECEDING) c, 1/sum(w*w) OVER (PARTITION BY g)<0.8*n few, row_number() OVER (PARTITION BY g ORDER BY k)=n z FROM w),
m AS (SELECT g, k, n, w, few, greatest((CASE WHEN z THEN n ELSE ceil(c*n-0.37) END)-ceil((c-w)*n-0.37),0) m FROM s)
SELECT g, k, CASE WHEN few THEN m ELSE 1 END::bigint copies, round(CASE WHEN few THEN 1.0/n ELSE w END,7) weight FROM m WHERE NOT few OR m>0""")
def particle_filter(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("weight"))
    out = E.particle_update(p, "g", "k", F.col("x"), F.lit(25.0), 90.0, u=0.37, least=0.8)
    return rounded(out.groupBy("g", "k").agg(F.count("*").alias("copies"), F.first("weight").alias("weight")), 7)


@query("""WITH RECURSIVE d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events), h AS (SELECT user_id, i FROM d WHERE value>60),
r AS (SELECT user_id, min(i) i FROM h GROUP BY 1 UNION ALL SELECT r.user_id, (SELECT min(h.i) FROM h WHERE h.user_id=r.user_id AND h.i-r.i>=7) FROM r WHERE r.i IS NOT NULL) SELECT user_id, i FROM r WHERE i IS NOT NULL""")
def retrain_trigger(spark, sf_dir):
    from fieldloom.operators.frames import indexed

    e = indexed(load(spark, sf_dir, "events"), "user_id", TIME)
    return rounded(E.retrain_steps(e, "user_id", "i", "value", 60.0, 7))


@query("""WITH s AS (SELECT epoch_us(ts)/1e6 t, epoch_us(ts)/1e6+(event_id%13)-2 n, event_type<>'error' a FROM events)
SELECT count(*) FILTER (WHERE a) accepted_samples, count(*) FILTER (WHERE NOT a) rejected_samples, round((SELECT greatest(n-t,0) FROM s WHERE a ORDER BY n DESC, t DESC LIMIT 1),4) latest_lag_seconds, round(max(greatest(n-t,0)) FILTER (WHERE a),4) maximum_lag_seconds FROM s""")
def stream_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", seconds().alias("t"), (seconds() + F.col("event_id") % 13 - 2).alias("n"))
    return rounded(sensors.metrics(e, F.col("event_type") != "error", "t", "n"), 4)


# --- Morphology ----------------------------------------------------------------------------------------------------

_MASK = "m AS (SELECT DISTINCT p_size::bigint i, (p_partkey*7%40) j FROM part WHERE p_partkey%10<7)"
_O4 = "o AS (SELECT * FROM (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) v(a,b))"


def _mask(spark, sf_dir):
    p = load(spark, sf_dir, "part").filter("p_partkey % 10 < 7")
    return p.select(F.col("p_size").cast("long").alias("i"), (F.col("p_partkey") * 7 % 40).alias("j")).distinct()


def _dilated(x: str) -> str:
    return f"SELECT DISTINCT i+a i, j+b j FROM {x}, o WHERE i+a BETWEEN 0 AND 50 AND j+b BETWEEN 0 AND 39"


def _eroded(x: str) -> str:
    return f"SELECT i, j FROM (SELECT i+a i, j+b j FROM {x}, o) GROUP BY 1,2 HAVING count(*)=5"


@query(f"""WITH {_MASK}, {_O4}, d AS ({_dilated('m')}), e AS ({_eroded('m')}), op AS ({_dilated('e')}), cl AS ({_eroded('d')})
SELECT 'dilation' op, i, j FROM d UNION ALL SELECT 'erosion', i, j FROM e UNION ALL SELECT 'opening', i, j FROM op UNION ALL SELECT 'closing', i, j FROM cl""")
def binary_morphology(spark, sf_dir):
    m = _mask(spark, sf_dir)
    found = {"dilation": M.dilate(m, "i", "j", (51, 40)), "erosion": M.erode(m, "i", "j"), "opening": M.opening(m, "i", "j", (51, 40)), "closing": M.closing(m, "i", "j", (51, 40))}
    parts = [df.select(F.lit(name).alias("op"), "i", "j") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH RECURSIVE m AS (SELECT DISTINCT p_size::bigint i, (p_partkey*7%40) j FROM part WHERE p_partkey%10<3), e AS (SELECT a.i*40+a.j a, b.i*40+b.j b FROM m a JOIN m b ON abs(a.i-b.i)+abs(a.j-b.j)=1), r AS (SELECT i*40+j n, i*40+j l FROM m UNION SELECT e.b, r.l FROM r JOIN e ON e.a=r.n),
f AS (SELECT n, min(l) l FROM r GROUP BY 1), s AS (SELECT l, count(*) c FROM f GROUP BY 1 HAVING count(*)>=2), k AS (SELECT l, c, row_number() OVER (ORDER BY l) k FROM s) SELECT n//40 i, n%40 j, k AS label, c size FROM f JOIN k ON k.l=f.l""")
def morphology_components(spark, sf_dir):
    m = load(spark, sf_dir, "part").filter("p_partkey % 10 < 3").select(F.col("p_size").cast("long").alias("i"), (F.col("p_partkey") * 7 % 40).alias("j")).distinct()
    return rounded(M.components(m, "i", "j", (51, 40), 2, tile=16))
