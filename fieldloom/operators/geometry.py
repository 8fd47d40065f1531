"""Triangles, tetrahedra, meshes and grids: areas, fluxes, forces, volumes, assembled matrices, components, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import TINY, cut, keys
from .joins import radius_pairs

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))  # type: ignore[return-value]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def area_vector(a: str = "a", b: str = "b", c: str = "c") -> Vector:
    """Half the cross product of two edges: area times unit normal of a triangle with corner columns ax, ay, az, bx, ..."""
    n = cross(sub(vector(b), vector(a)), sub(vector(c), vector(a)))
    return tuple(0.5 * x for x in n)  # type: ignore[return-value]


def pressure_forces(tri: DataFrame, by, pressure: str, center: Sequence[float] = (0.0, 0.0, 0.0), reference: float = 0.0) -> DataFrame:
    """Force -sum (p - p_ref) A n and its moment about a centre, per group of triangles."""
    s, p = area_vector(), F.col(pressure) - reference
    f = tuple(-p * x for x in s)
    arm = tuple((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 - m for c, m in zip("xyz", center))
    m = cross(arm, f)
    return tri.groupBy(*keys(by)).agg(*(F.sum(v).alias(n) for n, v in zip(("fx", "fy", "fz", "mx", "my", "mz"), (*f, *m))))


def plane_flux(tri: DataFrame, by, velocity: str, scalar: str, density: float = 1.0) -> DataFrame:
    """Volume and mass flow, scalar and kinetic-energy flux, area mean and flux-weighted mean of a scalar."""
    s, u, q = area_vector(), vector(velocity), F.col(scalar)
    un, area = dot(u, s), F.sqrt(dot(s, s))
    out = tri.groupBy(*keys(by)).agg(F.sum(un).alias("flow"), F.sum(density * un).alias("mass_flux"), F.sum(density * q * un).alias("scalar_flux"), F.sum(0.5 * density * dot(u, u) * un).alias("energy_flux"), F.sum(area).alias("area"), F.sum(q * area).alias("qa_"))
    mean = F.when(F.col("area") < TINY, 0.0).otherwise(F.col("qa_") / F.greatest("area", F.lit(TINY)))
    flux_mean = F.when(F.abs("mass_flux") < TINY, 0.0).otherwise(F.col("scalar_flux") / F.when(F.abs("mass_flux") < TINY, 1.0).otherwise(F.col("mass_flux")))
    return out.withColumns({"area_average": mean, "mass_weighted_average": flux_mean}).drop("qa_")


def tet_volume(a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> Column:
    """|(b - a) . ((c - a) x (d - a))| / 6."""
    o = vector(a)
    return F.abs(dot(sub(vector(b), o), cross(sub(vector(c), o), sub(vector(d), o)))) / 6


def with_corners(cells: DataFrame, points: DataFrame, vertices: str, names: Sequence[str]) -> DataFrame:
    """Cells with the coordinates of their vertices as columns <name>x, <name>y, <name>z: an equi-join a vertex."""
    out = cells
    for i, n in enumerate(names):
        p = points.select(F.col("point_id").alias(f"{n}_"), *(F.col(c).alias(f"{n}{c}") for c in "xyz"))
        out = out.join(p, out[vertices][i] == p[f"{n}_"]).drop(f"{n}_")
    return out


def lumped_mass(tri: DataFrame, vertices: str, area: str) -> DataFrame:
    """(node, mass): a third of each triangle's area for each of its nodes."""
    return tri.select(F.explode(vertices).alias("node"), (F.col(area) / 3).alias("m")).groupBy("node").agg(F.sum("m").alias("mass"))


def assemble(entries: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Sparse assembly: entries of the same place are summed."""
    return entries.groupBy(row, col).agg(F.sum(value).alias(value))



def min_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): connected components by min-label propagation with pointer jumping, checkpointed each round."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        heard = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        near = label.join(heard, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = near.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        new = cut(near.join(jump, "l", "left").select("u", "old", F.least("l", F.coalesce("ll", "l")).alias("l")))
        label = new.select("u", "l")
        if new.filter("l <> old").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("label"))


def dbscan(points: DataFrame, pid: str, coordinates: Sequence[str], eps: float, least: int) -> DataFrame:
    """(pid, cluster): core points with at least ``least`` neighbours (themselves included) within eps; -1 for noise.

    Clusters take the smallest core id; a border point that touches several joins the smallest. Points of equal coordinates
    are one place, named after its smallest id, that counts as often as it has points.
    """
    co = list(coordinates)
    places = cut(points.groupBy(*co).agg(F.min(pid).alias("b"), F.count("*").alias("m_")))
    near = radius_pairs(places, places.select(F.col("b").alias("a"), *co), "b", "a", co, eps).join(places.select("b", "m_"), "b")
    near = cut(near.select("a", "b", "m_"))
    core = cut(near.groupBy("a").agg(F.sum("m_").alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("core")))
    linked = near.join(core, near["a"] == core["core"], "left_semi").join(core.withColumnRenamed("core", "b"), "b", "left_semi")
    label = min_labels(linked, "a", "b").withColumnRenamed("node", "b")
    found = near.join(label, "b").groupBy("a").agg(F.min("label").alias("reach"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("own"))
    at = places.select(*co, F.col("b").alias("a")).join(found, "a")
    return points.select(pid, *co).join(at, co, "left").select(pid, F.coalesce("own", "reach", F.lit(-1)).alias("cluster"))
