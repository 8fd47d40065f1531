"""ASCII OpenFOAM meshes (polyMesh folders) as tables of points, faces, cells and patches, and the geometry of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.frames import cut, running

from .gmsh import numbered_lines

_NUMBER = r"[-+0-9.eE]+"


def _entries(spark: SparkSession, folders: str, name: str) -> DataFrame:
    """(mesh, i, text): the entries of a list file in every folder. An entry is a line, or all stand in one line if they are few."""
    lines = numbered_lines(spark, f"{folders}/{name}", {"open": (F.col("text") == "(").cast("int"), "shut": (F.col("text") == ")").cast("int"), "binary": F.col("text").rlike(r"^format\s+binary").cast("int")})
    wrong = lines.filter("binary > 0").select("path").first()
    if wrong:
        raise ValueError(f"{wrong['path']}: binary lists are not read")
    mesh = F.regexp_replace("path", "/[^/]*$", "").alias("mesh")
    of_lines = running(lines.filter("open > 0 AND shut = 0 AND text NOT IN ('(', '')").select(mesh, "line", "text"), "mesh", "line", {"i": F.lit(1)}).select("mesh", (F.col("i") - 1).alias("i"), "text")
    # Lists of ten or fewer numbers or vectors are written as n(a b ...).
    inner = F.regexp_extract("text", r"^\d+\s*\((.*)\)$", 1)
    each = F.when(inner.contains("("), F.regexp_extract_all(inner, F.lit(r"(\([^()]*\))"))).otherwise(F.split(F.trim(inner), " "))
    of_one = lines.filter((F.col("open") == 0) & F.col("text").rlike(r"^\d+\s*\(.*\)$")).select(mesh, F.posexplode(each).alias("i", "text"))
    return of_lines.unionByName(of_one.withColumn("i", F.col("i").cast("long")))


def read_poly_mesh(spark: SparkSession, folders: str) -> dict[str, DataFrame]:
    """points, faces, cells and patches of all polyMesh folders that a path or pattern names.

    points: mesh, point_id, x, y, z. faces: mesh, face_id, vertex_ids, owner, neighbour (null at the border), patch (null
    inside). cells: mesh, cell_id, face_ids and vertex_ids in ascending order. patches: mesh, patch, type, first, n. List
    files are read by lines and may be split over tasks; what belongs together meets by ids. Binary files raise an error.
    """
    points = cut(_entries(spark, folders, "points").withColumn("v", F.regexp_extract_all("text", F.lit(f"({_NUMBER})"))).select("mesh", F.col("i").alias("point_id"), *(F.col("v")[a].cast("double").alias(c) for a, c in enumerate("xyz"))))
    corners = F.split(F.regexp_extract("text", r"\(\s*(.*?)\s*\)", 1), r"\s+").cast("array<long>")
    faces = _entries(spark, folders, "faces").select("mesh", F.col("i").alias("face_id"), corners.alias("vertex_ids"))
    side = lambda name: _entries(spark, folders, name).select("mesh", F.col("i").alias("face_id"), F.col("text").cast("long").alias(name))
    text = spark.read.text(f"{folders}/boundary", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("mesh"), F.explode(F.regexp_extract_all("value", F.lit(r"(\w+\s*\{[^}]*\})"))).alias("e"))
    of = lambda key: F.regexp_extract("e", rf"\b{key}\s+(\w+)\s*;", 1)
    patches = text.filter(of("startFace") != "").select("mesh", F.regexp_extract("e", r"^(\w+)", 1).alias("patch"), of("type").alias("type"), of("startFace").cast("long").alias("first"), of("nFaces").cast("long").alias("n"))
    on_patch = patches.filter("n > 0").select("mesh", "patch", F.explode(F.expr("sequence(first, first + n - 1)")).alias("face_id"))
    on = ["mesh", "face_id"]
    faces = cut(faces.join(side("owner"), on, "left").join(side("neighbour"), on, "left").join(on_patch, on, "left"))
    both = faces.select("mesh", "face_id", "vertex_ids", F.explode(F.array("owner", "neighbour")).alias("cell_id")).filter("cell_id IS NOT NULL")
    cells = both.groupBy("mesh", "cell_id").agg(F.array_sort(F.collect_list("face_id")).alias("face_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("vertex_ids")))).alias("vertex_ids"))
    return {"points": points, "faces": faces, "cells": cells, "patches": patches}


def face_geometry(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh, face_id, sx, sy, sz, volume_part): area vectors, and what a face adds to its owner's volume.

    A face is a fan of triangles around the mean of its corners, so neighbours see the same surface where it isn't flat.
    """
    at = faces.select("mesh", "face_id", F.posexplode("vertex_ids").alias("i", "point_id")).join(points, ["mesh", "point_id"])
    ring = at.groupBy("mesh", "face_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("p"), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
    after = lambda i: F.col("p")[(i + 1) % F.size("p")]

    def total(term) -> Column:
        return F.aggregate(F.transform("p", lambda p, i: term(p, after(i))), F.lit(0.0), lambda a, v: a + v)

    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    area = {f"s{c}": total(lambda p, q, u=u, v=v: ((p[u] - F.col(f"m{u}")) * (q[v] - F.col(f"m{v}")) - (p[v] - F.col(f"m{v}")) * (q[u] - F.col(f"m{u}"))) / 2) for c, (u, v) in cross.items()}
    part = total(lambda p, q: sum(F.col(f"m{c}") * (p[u] * q[v] - p[v] * q[u]) for c, (u, v) in cross.items()) / 6)
    return ring.select("mesh", "face_id", *(c.alias(n) for n, c in area.items()), part.alias("volume_part"))


def cell_geometry(mesh: dict[str, DataFrame]) -> DataFrame:
    """(mesh, cell_id, volume, surface, openness) of the cells of ``read_poly_mesh``.

    A face's area vector points out of its owner and into its neighbour. ``openness`` is the length of a cell's summed
    area vectors over its surface, 0 if the cell is closed.
    """
    f = mesh["faces"].join(face_geometry(mesh["points"], mesh["faces"]), ["mesh", "face_id"])
    sides = F.explode(F.array(F.struct(F.col("owner").alias("cell_id"), F.lit(1.0).alias("s")), F.struct(F.col("neighbour").alias("cell_id"), F.lit(-1.0).alias("s")))).alias("o")
    f = f.select("mesh", "sx", "sy", "sz", "volume_part", sides).filter("o.cell_id IS NOT NULL")
    s = F.col("o.s")
    norm = lambda x, y, z: F.sqrt(x * x + y * y + z * z)
    out = f.groupBy("mesh", "o.cell_id").agg(F.sum(s * F.col("volume_part")).alias("volume"), F.sum(norm(F.col("sx"), F.col("sy"), F.col("sz"))).alias("surface"), *(F.sum(s * F.col(f"s{c}")).alias(f"t{c}") for c in "xyz"))
    return out.select("mesh", "cell_id", "volume", "surface", F.try_divide(norm(F.col("tx"), F.col("ty"), F.col("tz")), F.col("surface")).alias("openness"))
