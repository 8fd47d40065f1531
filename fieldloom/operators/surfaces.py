"""Distances to triangulated surfaces: the nearest triangle by cells of places that halve, with signs by pseudonormals.

Triangles are columns (tri, ax..cz). Points of equal coordinates are one place. A cell holds places within rho of its
centre, so only triangles at most 2 rho farther from the centre than the nearest one can be nearest to a place of it.
Cells are halved along each axis, and keep those triangles of the cell they came from, until a place meets few; so the
work follows neither the triangles' density nor the radius that would have to be searched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

XYZ = "xyz"
CORNERS = tuple(f"{v}{c}" for v in "abc" for c in XYZ)
PLACE, CENTRE = ("px", "py", "pz"), ("cx_", "cy_", "cz_")
KINDS = ("face", "ab", "bc", "ca", "a", "b", "c")


def _dot(u: Sequence[Column], v: Sequence[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _minus(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [p - q for p, q in zip(u, v)]


def _cross(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _corner(v: str) -> list[Column]:
    return [F.col(f"{v}{c}") for c in XYZ]


def _closest(rows: pa.RecordBatch, at: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(squared distance, kind, point): of each row's triangle the point closest to the columns ``at``, and the face, edge or corner on which it lies.

    It is the foot on the plane if that is inside, else the nearest point of the three sides; a triangle without an area is
    its sides.
    """
    column = lambda names: [rows.column(c).to_numpy(zero_copy_only=False) for c in names]
    a, b, c, p = (column(names) for names in (*(tuple(f"{v}{k}" for k in XYZ) for v in "abc"), at))
    with np.errstate(all="ignore"):
        e, f, g, w = _minus(b, a), _minus(c, a), _minus(c, b), _minus(p, a)
        ee, ff, gg, ef, we, wf, wg = _dot(e, e), _dot(f, f), _dot(g, g), _dot(e, f), _dot(w, e), _dot(w, f), _dot(_minus(w, e), g)
        te, tf, tg = (np.where(long_ > 0, np.clip(x / long_, 0.0, 1.0), 0.0) for x, long_ in ((we, ee), (wf, ff), (wg, gg)))
        area, u, v = ee * ff - ef * ef, ff * we - ef * wf, ee * wf - ef * we
        inside = (area > 0) & (u > 0) & (v > 0) & (u + v < area)
        end = lambda t, at0, at1, between: np.where(t <= 0, at0, np.where(t >= 1, at1, between))
        # From the first corner to the closest point of the face and of each side.
        to = [([u / area * x + v / area * y for x, y in zip(e, f)], np.zeros(len(u), int)), ([te * x for x in e], end(te, 4, 5, 1)), ([x + tg * y for x, y in zip(e, g)], end(tg, 5, 6, 2)), ([tf * x for x in f], end(tf, 4, 6, 3))]
        d2, kind, q = np.full(len(u), np.inf), np.full(len(u), 4), [np.zeros(len(u))] * 3
        for i, (r, k) in enumerate(to):
            away = _minus(w, r)
            far = _dot(away, away)
            nearer = ((far < d2) | (far == d2) & (k < kind)) & (True if i else inside)
            d2, kind, q = np.where(nearer, far, d2), np.where(nearer, k, kind), [np.where(nearer, x, y) for x, y in zip(r, q)]
    return d2, kind, [x + y for x, y in zip(a, q)]


def _least(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row the least x of its group."""
    which = np.unique(group, return_inverse=True)[1]
    out = np.full(len(x), np.inf)
    np.minimum.at(out, which, x)
    return out[which]


FEW = 50_000  # rows of a table that is broadcast
PAIRS_OF_CELL = 2_000_000  # pairs of places and triangles that may meet by a cell
PAIRS_OF_PLACE = 32  # triangles that a place may meet, on average
DEEPEST = 50  # halvings


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _finite(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.filter(" and ".join(f"abs({c}) < double('infinity')" for c in names))


def _nearest(points: DataFrame, triangles: DataFrame, tri: str) -> DataFrame:
    """(px, py, pz, tri, distance, kind, x, y, z) of each place of points."""
    corners = _finite(triangles.select(F.col(tri).alias("tri_"), *(F.col(c).cast("double").alias(c) for c in CORNERS)), CORNERS)
    corners = cut(corners.groupBy(*CORNERS).agg(F.min("tri_").alias("tri_")))
    n_triangles, size = corners.agg(F.count("*"), F.max(F.greatest(*map(F.abs, CORNERS)))).first()
    places = cut(_finite(points.select(*(F.col(c).cast("double").alias(f"p{c}") for c in XYZ)), PLACE).distinct().withColumn("place_", F.monotonically_increasing_id()))
    ends = places.agg(F.count("*").alias("n"), *(f(p).alias(f"{n}{p}") for p in PLACE for n, f in (("lo", F.min), ("hi", F.max)))).first()
    tri_type = dict(corners.dtypes)["tri_"]
    if not n_triangles or not ends["n"]:
        empty = places.limit(0).select(*PLACE, F.lit(None).cast(tri_type).alias(tri), F.lit(0.0).alias("distance"), F.lit("").alias("kind"))
        return empty.select("*", *(F.col(f"p{c}").alias(c) for c in XYZ))
    span = max(ends[f"hi{p}"] / 2 - ends[f"lo{p}"] / 2 for p in PLACE) or 1.0
    slack = 1e-10 * max(size, *(abs(ends[f"{n}{p}"]) for p in PLACE for n in ("lo", "hi")))  # for what rounding does to distances
    steps = float(2**DEEPEST - 1)
    places = places.withColumns({f"i{c}": F.floor((F.col(f"p{c}") / 2 - ends[f"lop{c}"] / 2) / span * steps).cast("long") for c in XYZ})
    most = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    corners = corners.repartition(max(1, min(most, n_triangles // 250), n_triangles // 20_000))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that no other of the batch rules out, with their distances from the centre."""
        for rows in batches:
            d = np.sqrt(_closest(rows, CENTRE)[0])
            cell, rho = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("cell_", "rho_"))
            out = rows.select([c for c in rows.schema.names if c not in CENTRE]).append_column("d_", pa.array(d))
            yield out.filter(pa.array(~(d > _limit(_least(cell, d), rho, slack))))

    cells = points.sparkSession.range(1).select(F.lit(0).cast("long").alias("cell_"), *(F.lit(0).cast("long").alias(f"g{c}") for c in XYZ))
    held, rows, n_cells, level = corners.withColumn("cell_", F.lit(0).cast("long")), n_triangles, 1, 0
    pairs = biggest = ends["n"] * n_triangles
    grid = lambda at: {f"g{c}": F.shiftright(f"i{c}", DEEPEST - at) for c in XYZ}
    while level < DEEPEST and (pairs > max(PAIRS_OF_CELL, PAIRS_OF_PLACE * ends["n"]) or rows > FEW and biggest > PAIRS_OF_CELL):
        level += 1
        lo, hi = ([F.col(f"{n}{p}") for p in PLACE] for n in ("lo", "hi"))
        boxes = places.withColumns(grid(level)).groupBy("gx", "gy", "gz").agg(F.count("*").alias("n_"), *(f(p).alias(f"{n}{p}") for p in PLACE for n, f in (("lo", F.min), ("hi", F.max))))
        half = [b / 2 - a / 2 for a, b in zip(lo, hi)]
        boxes = boxes.select("gx", "gy", "gz", "n_", F.sqrt(_dot(half, half)).alias("rho_"), *((a / 2 + b / 2).alias(c) for a, b, c in zip(lo, hi, CENTRE)))
        above = cells.select(F.col("cell_").alias("from_"), *(F.col(f"g{c}").alias(f"h{c}") for c in XYZ))
        of = [F.shiftright(f"g{c}", 1) == F.col(f"h{c}") for c in XYZ]
        boxes = boxes.join(_held(above, n_cells), of[0] & of[1] & of[2]).drop("hx", "hy", "hz")
        cells = cut(boxes.withColumn("cell_", F.monotonically_increasing_id()))
        n_cells = cells.count()
        met = held.select("tri_", *CORNERS, F.col("cell_").alias("from_")).join(_held(cells.drop("gx", "gy", "gz"), n_cells), "from_").select("cell_", "n_", "rho_", "tri_", *CORNERS, *CENTRE)
        schema = f"cell_ long, n_ long, rho_ double, tri_ {tri_type}, " + ", ".join(f"{c} double" for c in (*CORNERS, "d_"))
        met = cut(met.mapInArrow(kept, schema))
        held = met.join(_held(met.groupBy("cell_").agg(F.min("d_").alias("least_")), n_cells), "cell_").filter(F.col("d_") <= _limit(F.col("least_"), F.col("rho_"), slack))
        each = held.groupBy("cell_").agg(F.count("*").alias("k_"), F.max("n_").alias("n_"))
        pairs, biggest, rows = each.agg(F.sum(F.col("k_") * F.col("n_")), F.max(F.col("k_") * F.col("n_")), F.sum("k_")).first()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of each place's triangles in the batch, equals too."""
        for rows in batches:
            d2, kind, q = _closest(rows, PLACE)
            out = pa.RecordBatch.from_arrays([rows.column("place_"), pa.array(d2), rows.column("tri_"), pa.array(kind.astype("int32")), *map(pa.array, q), *map(rows.column, PLACE)], names=found)
            yield out.filter(pa.array(~(d2 > _least(rows.column("place_").to_numpy(zero_copy_only=False), d2))))

    found = ["place_", "d2_", "tri_", "kind_", *XYZ, *PLACE]
    at = places.withColumns(grid(level)).join(_held(cells.select("cell_", "gx", "gy", "gz"), n_cells), ["gx", "gy", "gz"]).select("cell_", "place_", *PLACE)
    near = at.join(_held(held.select("cell_", "tri_", *CORNERS), rows), "cell_").select("place_", "tri_", *CORNERS, *PLACE)
    near = near.mapInArrow(nearest, f"place_ long, d2_ double, tri_ {tri_type}, kind_ int, " + ", ".join(f"{c} double" for c in (*XYZ, *PLACE)))
    best = near.groupBy("place_").agg(F.min(F.struct(*found[1:])).alias("m_"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("m_.kind_") + 1)
    return cut(best.select(*(F.col(f"m_.{p}") for p in PLACE), F.col("m_.tri_").alias(tri), F.sqrt("m_.d2_").alias("distance"), kind.alias("kind"), *(F.col(f"m_.{c}") for c in XYZ)))


def _limit(least, rho, slack: float):
    """How far from a cell's centre a triangle may be that is nearest to a place of the cell."""
    return least + 2 * rho + 1e-6 * (least + rho) + slack


def _at_places(points: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """points with the columns that found has for their places."""
    own = points.withColumns({f"p{c}_": F.col(c).cast("double") for c in XYZ})
    return own.join(found.withColumnsRenamed({p: f"{p}_" for p in PLACE}), [f"{p}_" for p in PLACE], how).drop(*(f"{p}_" for p in PLACE))


def nearest_triangle(points: DataFrame, triangles: DataFrame, pid: str, tri: str, cell: float | None = None) -> DataFrame:
    """(pid, tri, distance, kind, x, y, z): the triangle nearest to each point (x, y, z), the smallest id of equals, and the closest point on it.

    Points and triangles with a null or infinite coordinate are left out. The search finds its cells itself; ``cell``, the
    radius of a first round in an earlier form, changes nothing.
    """
    found = _nearest(points, triangles, tri).withColumnsRenamed({c: f"q{c}_" for c in XYZ})
    return _at_places(points.select(pid, *XYZ), found, "inner").select(pid, tri, "distance", "kind", *(F.col(f"q{c}_").alias(c) for c in XYZ))


def _parts(triangles: DataFrame, tri: str) -> DataFrame:
    """(tri, kind, key, nx, ny, nz): what each triangle adds to the pseudonormals of its edges (its normal) and corners (its normal times the angle there)."""
    a, b, c = map(_corner, "abc")
    n = _cross(_minus(b, a), _minus(c, a))
    size = F.sqrt(_dot(n, n))
    unit = [F.when(size > 0, x / size).otherwise(0.0) for x in n]
    at = lambda v: F.struct(*(x.alias(k) for x, k in zip(v, XYZ)))
    rows = []
    for kind, u, v in (("ab", a, b), ("bc", b, c), ("ca", c, a)):
        rows.append(F.struct(F.lit(kind).alias("kind"), F.array_sort(F.array(at(u), at(v))).alias("key"), F.lit(1.0).alias("w")))
    for kind, u, v, w in (("a", a, b, c), ("b", b, c, a), ("c", c, a, b)):
        s, t = _minus(v, u), _minus(w, u)
        angle = F.atan2(size, _dot(s, t))
        rows.append(F.struct(F.lit(kind).alias("kind"), F.array(at(u)).alias("key"), angle.alias("w")))
    each = triangles.select(F.col(tri), *(x.alias(f"n{k}") for x, k in zip(unit, XYZ)), F.explode(F.array(*rows)).alias("r"))
    return each.select(tri, "r.kind", "r.key", *((F.col(f"n{k}") * F.col("r.w")).alias(f"n{k}") for k in XYZ), *(F.col(f"n{k}").alias(f"f{k}") for k in XYZ))


def is_closed(triangles: DataFrame, tri: str) -> bool:
    """Whether each edge belongs to two triangles; corners that coincide are one."""
    edges = _parts(triangles, tri).filter(F.size("key") == 2).groupBy("key").count()
    return edges.agg(F.coalesce(F.every(F.col("count") == 2), F.lit(False))).first()[0]


def _signed(points: DataFrame, triangles: DataFrame, tri: str) -> DataFrame:
    """(px, py, pz, tri, distance, signed) of each place of points."""
    near = _nearest(points, triangles, tri)
    parts = _parts(triangles, tri)
    sums = parts.groupBy("key").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in XYZ))
    around = parts.select(tri, "kind", "key").join(sums, "key").select(tri, "kind", *(f"n{k}" for k in XYZ))
    faces = parts.filter("kind = 'a'").select(tri, F.lit("face").alias("kind"), *(F.col(f"f{k}").alias(f"n{k}") for k in XYZ))
    side = sum((F.col(f"p{k}") - F.col(k)) * F.col(f"n{k}") for k in XYZ)
    found = near.join(around.unionByName(faces), [tri, "kind"])
    return found.select(*PLACE, tri, "distance", (F.col("distance") * F.when(side < 0, -1.0).otherwise(1.0)).alias("signed"))


def signed_distance(points: DataFrame, triangles: DataFrame, pid: str, tri: str, cell: float | None = None) -> DataFrame:
    """(pid, tri, distance, signed): negative where a closed surface with outward normals holds the point.

    The sign is that of the pseudonormal of the face, edge or corner that is closest: the sum of the normals around it,
    at corners by their angles. For open surfaces only the size counts. ``cell`` is as in nearest_triangle.
    """
    return _at_places(points.select(pid, *XYZ), _signed(points, triangles, tri), "inner").select(pid, tri, "distance", "signed")


def attach_wall_features(points: DataFrame, triangles: DataFrame, pid: str, tri: str, cell: float | None = None, prefix: str = "wall") -> DataFrame:
    """points with ``<prefix>_distance`` to the surface, and ``<prefix>_sdf`` with its sign if the surface is closed. Null without a surface."""
    if is_closed(triangles, tri):
        found = _signed(points, triangles, tri).select(*PLACE, F.col("distance").alias(f"{prefix}_distance"), F.col("signed").alias(f"{prefix}_sdf"))
    else:
        found = _nearest(points, triangles, tri).select(*PLACE, F.col("distance").alias(f"{prefix}_distance"))
    return _at_places(points, found, "left")
