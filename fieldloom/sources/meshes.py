"""Mesh and field text formats as long tables.

Files are read by Spark as whole texts, one row a file, and parsed by the task that holds it, so many cases are read in
parallel. Each parser gives rows of one schema: kind (point, cell, patch, field), id, name, values, vertices.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gmsh import read_gmsh

SCHEMA = "path string, kind string, id long, name string, values array<double>, vertices array<long>"
Row = tuple[str, int, str | None, list[float] | None, list[int] | None]

# Vertices of an element type (VTK numbering, as SU2 uses it).
VERTICES = {3: 2, 5: 3, 9: 4, 10: 4, 12: 8, 13: 6, 14: 5}
# Vertices of a Gmsh element type.
GMSH_VERTICES = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 15: 1}


def parse_su2(text: str) -> Iterator[Row]:
    """NDIME, NELEM, NPOIN and NMARK sections; a trailing index of a row is left out."""
    lines = [x for x in (y.split("%")[0].strip() for y in text.splitlines()) if x]
    at, dim, marker = 0, 0, None

    def section(n: int) -> list[list[str]]:
        return [x.split() for x in lines[at + 1 : at + 1 + n]]

    while at < len(lines):
        key, _, value = (x.strip() for x in lines[at].partition("="))
        n = 0
        if key == "NDIME":
            dim = int(value)
        elif key == "NELEM":
            n = int(value)
            for i, row in enumerate(section(n)):
                yield "cell", i, row[0], None, [int(v) for v in row[1 : 1 + VERTICES[int(row[0])]]]
        elif key == "NPOIN":
            n = int(value.split()[0])
            for i, row in enumerate(section(n)):
                yield "point", i, None, ([float(v) for v in row[:dim]] + [0.0])[:3], None
        elif key == "MARKER_TAG":
            marker = value
        elif key == "MARKER_ELEMS":
            n = int(value)
            for i, row in enumerate(section(n)):
                yield "patch", i, marker, None, [int(v) for v in row[1 : 1 + VERTICES[int(row[0])]]]
        at += 1 + n
    if not dim:
        raise ValueError("no NDIME: not an SU2 mesh")


def parse_vtk(text: str) -> Iterator[Row]:
    """Legacy ASCII unstructured grids with point and cell scalars and vectors."""
    if "ASCII" not in text[:400] or "UNSTRUCTURED_GRID" not in text:
        raise ValueError("not a legacy ASCII unstructured grid")
    words, at = text.split("\n", 2)[2].split(), 0
    where, count, types = "point", 0, []

    def take(n: int) -> list[str]:
        nonlocal at
        at += n
        return words[at - n : at]

    cells: list[list[int]] = []
    while at < len(words):
        word = take(1)[0]
        if word == "POINTS":
            n = int(take(2)[0])
            xyz = [float(v) for v in take(3 * n)]
            for i in range(n):
                yield "point", i, None, xyz[3 * i : 3 * i + 3], None
        elif word == "CELLS":
            n = int(take(2)[0])
            for _ in range(n):
                cells.append([int(v) for v in take(int(take(1)[0]))])
        elif word == "CELL_TYPES":
            types = take(int(take(1)[0]))
            for i, c in enumerate(cells):
                yield "cell", i, types[i], None, c
        elif word in ("POINT_DATA", "CELL_DATA"):
            where, count = word.split("_")[0].lower(), int(take(1)[0])
        elif word == "SCALARS":
            name, _ = take(2)
            parts = int(take(1)[0]) if words[at] != "LOOKUP_TABLE" else 1
            take(2)
            for i in range(count):
                yield "field", i, f"{where}:{name}", [float(v) for v in take(parts)], None
        elif word == "VECTORS":
            name, _ = take(2)
            for i in range(count):
                yield "field", i, f"{where}:{name}", [float(v) for v in take(3)], None


def parse_fluent(text: str) -> Iterator[Row]:
    """ASCII sections: 2010 nodes, 2013 faces, 2040 zones, 3010 fields; a comment before a field section names it."""
    found = False
    comment = None
    for m in re.finditer(r'\(0 "([^"]*)"\)|\((\d+) \(([0-9a-fA-F ]+)\)\s*(?:\(([^()]*)\)|"([^"]*)")', text):
        if m[1] is not None:
            comment = m[1]
            continue
        section, head, rows = int(m[2]), m[3].split(), [r.split() for r in (m[4] or "").strip().splitlines() if r.strip()]
        found = True
        if section == 2010:
            for i, r in enumerate(rows):
                yield "point", i, None, ([float(v) for v in r] + [0.0])[:3], None
        elif section == 2013:
            for i, r in enumerate(rows):
                yield "patch", i, head[0], None, [int(v) for v in r[1 : 1 + int(r[0])]]
        elif section == 2040:
            yield "patch", int(head[0]), m[5], None, None
        elif section == 3010:
            for i, r in enumerate(rows):
                yield "field", i, f"point:{(comment or head[0]).split()[-1]}", [float(v) for v in r], None
    if not found:
        raise ValueError("no known section: not an ASCII case or data file")


def parse_gmsh(text: str) -> Iterator[Row]:
    """ASCII format 2.2."""
    parts = {m[1]: m[2].split("\n") for m in re.finditer(r"\$(\w+)\n(.*?)\n\$End\1", text, re.S)}
    if not parts.get("MeshFormat", [""])[0].startswith("2."):
        raise ValueError("not an ASCII Gmsh 2 mesh")
    number = {}
    for i, line in enumerate(parts["Nodes"][1:]):
        r = line.split()
        number[r[0]] = i
        yield "point", i, None, [float(v) for v in r[1:4]], None
    for i, line in enumerate(parts["Elements"][1:]):
        r = line.split()
        yield "cell", i, r[1], None, [number[v] for v in r[3 + int(r[2]) :][: GMSH_VERTICES[int(r[1])]]]


def parse_foam(text: str) -> Iterator[Row]:
    """A field file (uniform or nonuniform internal field, patch types) or a list of points."""
    header = re.search(r"FoamFile\s*\{(.*?)\}", text, re.S)
    if not header:
        raise ValueError("no FoamFile header")
    entry = dict(re.findall(r"(\w+)\s+([^;]+);", header[1]))
    body, name = text[header.end() :], entry.get("object", "field")
    number = r"[-+0-9.eE]+"
    if entry.get("class") == "vectorField":
        for i, m in enumerate(re.finditer(rf"\(\s*({number})\s+({number})\s+({number})\s*\)", body)):
            yield "point", i, None, [float(v) for v in m.groups()], None
        return
    m = re.search(r"internalField\s+(uniform|nonuniform)\s+(.*?);", body, re.S)
    if m and m[1] == "uniform":
        yield "field", -1, f"cell:{name}", [float(v) for v in re.findall(number, m[2])], None
    elif m:
        inner = m[2][m[2].index("(") + 1 :]
        rows = re.findall(r"\(([^()]*)\)", inner) if "vector" in m[2][:30] else inner.rstrip(")\n ").split()
        for i, r in enumerate(rows):
            yield "field", i, f"cell:{name}", [float(v) for v in r.split()], None
    for m in re.finditer(r"(\w+)\s*\{\s*type\s+(\w+);", body):
        yield "patch", -1, f"{m[1]}:{m[2]}", None, None


PARSERS: dict[str, Callable[[str], Iterator[Row]]] = {"su2": parse_su2, "vtk": parse_vtk, "cas": parse_fluent, "dat": parse_fluent, "msh": parse_gmsh, "foam": parse_foam}


def read_mesh(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, DataFrame]:
    """points, cells, patches and fields of all files at path, by the format's name or the path's extension."""
    kind = kind or path.rpartition(".")[2].lower()
    if kind not in PARSERS:
        raise ValueError(f"no reader for {kind}; known are {', '.join(sorted(PARSERS))}")
    if kind == "msh":
        return read_gmsh(spark, path)
    parse = PARSERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, text in zip(pdf["path"], pdf["value"]):
                rows = [(p, *r) for r in parse(text)]
                yield pd.DataFrame(rows, columns=["path", "kind", "id", "name", "values", "vertices"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    every = files.mapInPandas(run, SCHEMA)
    v = F.col("values")
    return {
        "points": every.filter("kind = 'point'").select("path", F.col("id").alias("point_id"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z")),
        "cells": every.filter("kind = 'cell'").select("path", F.col("id").alias("cell_id"), F.col("name").cast("int").alias("cell_type"), F.col("vertices").alias("vertex_ids")),
        "patches": every.filter("kind = 'patch'").select("path", F.col("id").alias("face_id"), "name", F.col("vertices").alias("vertex_ids")),
        "fields": every.filter("kind = 'field'").select("path", F.split("name", ":")[0].alias("location"), F.split("name", ":")[1].alias("field"), F.col("id").alias("entity_id"), v.alias("value")),
    }


def csv_snapshots(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """(file_idx, point_id, value) of one column of CSV files with equal row counts; KeyError or ValueError else."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.csv(path, header=True, inferSchema=False)
        if column not in one.columns:
            raise KeyError(f"{path} has no column {column}")
        rows = one.select(F.lit(i).alias("file_idx"), F.monotonically_increasing_id().alias("at_"), F.col(column).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    from pyspark.sql import Window

    out = out.withColumn("point_id", F.row_number().over(Window.partitionBy("file_idx").orderBy("at_")) - 1).drop("at_")
    if out.groupBy("file_idx").count().agg(F.countDistinct("count")).first()[0] > 1:
        raise ValueError("files differ in their number of rows")
    return out


def write_restart(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """SU2-like restart: a quoted header and tab-separated rows, sorted by order; a directory of part files with headers."""
    df.select(*columns).sortWithinPartitions(order).write.csv(path, sep="\t", header=True, quoteAll=False)


def read_restart(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(*(F.col(c).cast("double").alias(c) for c in raw.columns))
