"""ASCII Gmsh meshes of formats 2 and 4.1, read by lines, so that a file may be split over many tasks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.frames import cut, running

SECTIONS = ("MeshFormat", "Nodes", "Elements")
_CHAIN = "path string, section string, line long, d_head long, d_n long, d_type long, d_before long"


def numbered_lines(spark: SparkSession, path: str, counts: dict | None = None) -> DataFrame:
    """(path, line, text) of all text files at path, lines from 0, and running ``counts`` over the lines of a file."""
    m = "_metadata."
    raw = spark.read.text(path).select(F.col(m + "file_path").alias("path"), F.col(m + "file_block_start").alias("at_"), F.monotonically_increasing_id().alias("in_"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))
    got = running(raw, "path", ["at_", "in_"], {"line": F.lit(1), **(counts or {})})
    return got.select("path", (F.col("line") - 1).alias("line"), "text", *(counts or {}))


def _chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a section, a header leading to the next; of each what changes against the block before."""
    path, section = key
    first, form = int(rows["first"].iloc[0]), rows["form"].iloc[0]
    if form.startswith("2."):
        blocks = [(first, -1, -1, 0)]
    else:
        heads = {int(line): [int(v) for v in text.split()] for line, text in zip(rows["line"], rows["text"]) if re.fullmatch(r"\d+ \d+ \d+ \d+", text)}
        if first not in heads:
            raise ValueError(f"{path}: no header of {section}")
        at, before, blocks = first + 1, 0, []
        for _ in range(heads[first][0]):
            if at not in heads:
                raise ValueError(f"{path}: no block of {section} at line {at + 1}")
            dim, _, kind, n = heads[at]
            blocks.append((at, n, kind if section == "Elements" else dim, before))
            at, before = at + 1 + n * (1 if section == "Elements" else 2), before + n
    out, last = [], (0, 0, 0, 0)
    for b in blocks:
        out.append((path, section, b[0], *(x - y for x, y in zip(b, last))))
        last = b
    return pd.DataFrame(out, columns=[f.split()[0] for f in _CHAIN.split(", ")])


def read_gmsh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """points, cells, and empty patches and fields of all .msh files at path; ids count from 0 in the file's order.

    Lines are numbered over ranges. What a task holds of a file are the headers of its entity blocks (and the few lines
    that look like one), whose chain tells where a block begins; the lines themselves meet by key. A vertex that no node
    names is null. A file that is binary, of another format, or no mesh raises an error.
    """
    marks = {f"{side}{i}": (F.col("text") == f"${'End' if side == 'b' else ''}{s}").cast("int") for i, s in enumerate(SECTIONS) for side in "ab"}
    lines = numbered_lines(spark, path, marks)
    section = F.coalesce(*(F.when((F.col(f"a{i}") > F.col(f"b{i}")) & (F.col("text") != f"${s}"), s) for i, s in enumerate(SECTIONS)))
    lines = cut(lines.withColumn("section", section).select("path", "section", "line", "text"))
    forms = lines.filter("section = 'MeshFormat'").groupBy("path").agg(F.min_by("text", "line").alias("form"))
    known = F.col("form").rlike(r"^(2(\.\d+)?|4\.1) 0 ")
    wrong = lines.select("path").distinct().join(forms, "path", "left").filter(~F.coalesce(known, F.lit(False))).first()
    if wrong:
        raise ValueError(f"{wrong['path']}: not an ASCII Gmsh mesh of format 2 or 4.1")
    lines = lines.filter("section IN ('Nodes', 'Elements')")
    starts = lines.groupBy("path", "section").agg(F.min("line").alias("first")).join(forms, "path")
    # A block's header begins with its dimension; no more than three elements have a number as low as that.
    looks = lines.filter(F.col("text").rlike(r"^[0-3] \d+ \d+ \d+$")).select("path", "section", "line", "text")
    opening = lines.join(starts.select("path", F.col("first").alias("line")), ["path", "line"], "left_semi").select("path", "section", "line", "text")
    chain = looks.unionByName(opening).distinct().join(starts, ["path", "section"]).groupBy("path", "section").applyInPandas(_chain, _CHAIN)
    deltas = ("head", "n", "type", "before")
    marked = lines.join(chain, ["path", "section", "line"], "left")
    at = running(marked, ["path", "section"], "line", {d: F.coalesce(f"d_{d}", F.lit(0)) for d in deltas}, {"first": F.min("line")})
    at = at.withColumns({"j": F.col("line") - F.col("head") - 1, "t": F.split("text", " "), "old": F.col("n") < 0}).filter("head > 0 AND j >= 0")
    at = at.select("path", "section", "head", "n", "type", "before", "j", "t", "old")

    node, number = at.filter("section = 'Nodes'"), F.col("before") + F.col("j")
    xyz = lambda start: [F.col("t")[start + i].cast("double").alias(c) for i, c in enumerate("xyz")]
    old = node.filter("old").select("path", F.col("t")[0].cast("long").alias("tag"), F.col("j").alias("point_id"), *xyz(1))
    tags = node.filter("NOT old AND j < n").select("path", number.alias("point_id"), F.col("t")[0].cast("long").alias("tag"))
    places = node.filter("NOT old AND j >= n AND j < 2 * n").select("path", (number - F.col("n")).alias("point_id"), *xyz(0))
    points = cut(old.unionByName(tags.join(places, ["path", "point_id"])))

    cell = at.filter("section = 'Elements'")
    skip = F.when(F.col("old"), F.col("t")[2].cast("int") + 4).otherwise(2)
    kind = F.when(F.col("old"), F.col("t")[1].cast("int")).otherwise(F.col("type").cast("int"))
    corners = cell.select("path", number.alias("cell_id"), kind.alias("cell_type"), F.posexplode(F.slice("t", skip, F.size("t"))).alias("i", "tag"))
    corners = corners.withColumn("tag", F.col("tag").cast("long")).join(points.select("path", "tag", "point_id"), ["path", "tag"], "left")
    cells = corners.groupBy("path", "cell_id", "cell_type").agg(F.array_sort(F.collect_list(F.struct("i", "point_id"))).alias("v")).select("path", "cell_id", "cell_type", F.col("v.point_id").alias("vertex_ids"))
    return {
        "points": points.select("path", "point_id", "x", "y", "z"),
        "cells": cells,
        "patches": spark.createDataFrame([], "path string, face_id long, name string, vertex_ids array<long>"),
        "fields": spark.createDataFrame([], "path string, location string, field string, entity_id long, value array<double>"),
    }
