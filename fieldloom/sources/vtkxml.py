"""Unstructured grids and surfaces in VTK's XML format, and collections of them over time.

Files are read by Spark as bytes, a task a file, and give the rows of ``meshes.SCHEMA``. Arrays may be text, base64 or
appended bytes, compressed with zlib or not. A collection (.pvd) is read first: of a range of times only the files in it
are opened.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meshes import SCHEMA, Row

# NumPy types of the format's type names.
TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}
# Cell types of the pieces of a surface by their number of corners, and for more of them.
SURFACE = {"Verts": ({1: 1}, 2), "Lines": ({2: 3}, 4), "Strips": ({}, 6), "Polys": ({3: 5, 4: 9}, 7)}


class _Arrays:
    """Decodes the data arrays of one file."""

    def __init__(self, root: ET.Element, appended: bytes, raw: bool):
        self.order = ">" if root.get("byte_order") == "BigEndian" else "<"
        self.head = np.dtype(self.order + TYPES[root.get("header_type", "UInt32")])
        if root.get("compressor") not in (None, "vtkZLibDataCompressor"):
            raise ValueError(f"compressor {root.get('compressor')} is not read")
        self.zipped, self.appended, self.raw = root.get("compressor") is not None, appended, raw

    def values(self, a: ET.Element) -> np.ndarray:
        kind = np.dtype(self.order + TYPES[a.get("type")])
        form = a.get("format", "ascii")
        if form == "ascii":
            return np.array((a.text or "").split(), kind)
        data = (a.text or "").strip().encode() if form == "binary" else self.appended[int(a.get("offset", 0)) :]
        return np.frombuffer(self._bytes(data, form == "appended" and self.raw), kind)

    def _bytes(self, data: bytes, raw: bool) -> bytes:
        size = self.head.itemsize
        take = (lambda at, n: data[at : at + n]) if raw else (lambda at, n: base64.b64decode(data[at : at + -(-n // 3) * 4])[:n])
        width = (lambda n: n) if raw else (lambda n: -(-n // 3) * 4)  # of n bytes as they stand in the file
        if not self.zipped:
            n = int(np.frombuffer(take(0, size), self.head)[0])
            return take(0, size + n)[size:]
        blocks = int(np.frombuffer(take(0, size), self.head)[0])
        head = np.frombuffer(take(0, size * (3 + blocks)), self.head).astype(np.int64)
        begin = width(size * (3 + blocks))
        body = take(begin, int(head[3:].sum()))
        ends = np.cumsum(head[3:])
        return b"".join(zlib.decompress(body[e - c : e]) for e, c in zip(ends.tolist(), head[3:].tolist()))


def _split(data: bytes) -> tuple[ET.Element, bytes, bool]:
    """The XML without its appended bytes, those bytes, and whether they are raw."""
    m = re.search(rb"<AppendedData\b([^>]*)>\s*_", data)
    if not m:
        return ET.fromstring(data), b"", False
    end = data.rindex(b"</AppendedData>")
    return ET.fromstring(data[: m.start()] + data[end + len(b"</AppendedData>") :]), data[m.end() : end], b"base64" not in m[1]


def parse_vtk_xml(data: bytes) -> Iterator[Row]:
    """Points, cells and fields of all pieces of an UnstructuredGrid or PolyData file; pieces follow each other in their numbers."""
    root, appended, raw = _split(data)
    kind = root.get("type")
    if root.tag != "VTKFile" or kind not in ("UnstructuredGrid", "PolyData"):
        raise ValueError(f"no reader for {root.tag} of type {kind}")
    arrays, points, cells = _Arrays(root, appended, raw), 0, 0
    for piece in root.iter("Piece"):
        at = piece.find("Points/DataArray")
        xyz = arrays.values(at).reshape(-1, 3).astype(float) if at is not None else np.empty((0, 3))
        yield from (("point", points + i, None, x, None) for i, x in enumerate(xyz.tolist()))
        n = 0
        for part in ("Cells", *SURFACE):
            group = piece.find(part)
            found = {a.get("Name"): arrays.values(a) for a in group.findall("DataArray")} if group is not None else {}
            if not len(found.get("offsets", ())):
                continue
            ends = found["offsets"].astype(np.int64)
            of = np.split(found["connectivity"].astype(np.int64) + points, ends[:-1])
            for k, v in enumerate(of):
                number = int(found["types"][k]) if part == "Cells" else SURFACE[part][0].get(len(v), SURFACE[part][1])
                yield "cell", cells + n + k, str(number), None, v.tolist()
            n += len(of)
        for place, first in (("Point", points), ("Cell", cells)):
            for a in piece.findall(f"{place}Data/DataArray"):
                if a.get("type") in TYPES:
                    x = arrays.values(a).reshape(-1, int(a.get("NumberOfComponents") or 1)).astype(float)
                    yield from (("field", first + i, f"{place.lower()}:{a.get('Name')}", v, None) for i, v in enumerate(x.tolist()))
        points, cells = points + len(xyz), cells + n


def read_vtk_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows (path, kind, id, name, values, vertices) of all files; a task opens a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(path, *r) for r in parse_vtk_xml(bytes(content))], columns=["path", "kind", "id", "name", "values", "vertices"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, SCHEMA)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(time, part, file) of a .pvd file, files relative to it; sorted by nothing, a row a data set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                sets = list(ET.fromstring(bytes(content)).iter("DataSet"))
                yield pd.DataFrame([(float(s.get("timestep") or 0), int(s.get("part") or 0), s.get("file")) for s in sets], columns=["time", "part", "file"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "time double, part int, file string")


def read_times(spark: SparkSession, path: str, first: float = float("-inf"), last: float = float("inf"), files_at_most: int = 100_000) -> DataFrame:
    """(time, part, path, kind, id, name, values, vertices) of a collection's files with first <= time <= last; others are not opened."""
    rows = read_collection(spark, path).filter(F.col("time").between(first, last)).limit(files_at_most + 1).collect()
    if len(rows) > files_at_most:
        raise ValueError(f"more than {files_at_most} files in the range of times")
    folder = path.rpartition("/")[0]
    at = [(r["file"] if "://" in r["file"] or r["file"].startswith("/") else f"{folder}/{r['file']}") for r in rows]
    table = spark.createDataFrame([(r["time"], r["part"], p.rpartition("/")[2], p) for r, p in zip(rows, at)], "time double, part int, base_ string, at_ string")
    if not rows:
        return table.limit(0).selectExpr("time", "part", "at_ as path", "'' as kind", "0L as id", "'' as name", "cast(null as array<double>) as values", "cast(null as array<long>) as vertices")
    found = read_vtk_xml(spark, sorted(set(at)))
    # Spark writes a path as file:/x or hdfs://host/x: it ends with the name that was asked for.
    asked = F.regexp_replace("at_", "^[a-z0-9]+:(//[^/]*)?", "")
    return found.withColumn("base_", F.substring_index("path", "/", -1)).join(F.broadcast(table), "base_").filter(F.col("path").endswith(asked)).select("time", "part", "path", "kind", "id", "name", "values", "vertices")
