"""A converted copy of many mesh files that follows its sources: only what is new or changed is parsed.

The manifest has a row a file: path, length, time of modification, the batch that converted it, and what went wrong.
Files are listed by Spark without reading them; tasks open the changed ones only. A scan writes its rows as a new batch,
then a manifest that names it, and takes effect when that is renamed to the next version: readers see the old state or
the new one, and of two scans at once one fails. Batches that no manifest names are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.meshhash import mesh_classes, mesh_hashes

from . import meshes

MANIFEST = "path string, length long, modified timestamp, batch string, error string"
FILES_PER_TASK = 16


class Scan(NamedTuple):
    """kept and removed count entries of the manifest before: an entry whose file changed is removed, and converted anew."""

    version: int
    converted: int
    failed: int
    kept: int
    removed: int


class MeshCache:
    """Converted files under root: batches of rows (meshes.SCHEMA) and versions of the manifest."""

    def __init__(self, spark: SparkSession, root: str, parsers: dict[str, Callable] | None = None):
        self.spark, self.root, self.parsers = spark, root.rstrip("/"), parsers or meshes.PARSERS

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The manifest that counts; 0 before the first scan."""
        fs, where = self._fs(f"{self.root}/manifest")
        if not fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def manifest(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{n}") if n else self.spark.createDataFrame([], MANIFEST)

    def scan(self, source: str, pattern: str = "*") -> Scan:
        """Brings the copy to the state of the files under source whose names match pattern.

        A file counts as changed if its length or time differs. One that cannot be read or parsed is listed with its error,
        has no rows, and is tried again when it changes. Files that are gone leave the manifest.
        """
        n, batch = self.version(), uuid.uuid4().hex
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source)
        files = listed.select("path", "length", F.col("modificationTime").alias("modified"))
        old = self.manifest()
        kept = old.join(files, ["path", "length", "modified"], "left_semi")
        tmp = f"{self.root}/manifest/.{batch}"
        changed_at, rows_at = f"{self.root}/scan/{batch}", f"{self.root}/rows/batch={batch}"
        files.join(old, ["path", "length", "modified"], "left_anti").write.parquet(changed_at)
        changed = self.spark.read.schema("path string, length long, modified timestamp").parquet(changed_at)
        many = changed.count()
        if many:
            self._convert(changed, -(-many // FILES_PER_TASK)).write.parquet(rows_at)
            failed = self.spark.read.schema(meshes.SCHEMA).parquet(rows_at).filter("kind = 'error'").select("path", F.col("name").alias("error"))
            new = changed.join(failed, "path", "left").select("path", "length", "modified", F.lit(batch).alias("batch"), "error")
        else:
            new = self.spark.createDataFrame([], MANIFEST)
        kept.select("path", "length", "modified", "batch", "error").unionByName(new).write.parquet(tmp)
        written = self.spark.read.schema(MANIFEST).parquet(tmp)
        sums = written.agg(F.count("*"), F.count_if((F.col("batch") == batch) & F.col("error").isNotNull())).first()
        before = old.count()
        fs, where = self._fs(tmp)
        # Rename is atomic, and moves into a folder that exists instead of replacing it: then the other scan came first.
        to = self._fs(f"{self.root}/manifest/v{n + 1}")[1]
        if fs.exists(to) or not fs.rename(where, to):
            fs.delete(where, True)
            raise RuntimeError(f"another scan wrote version {n + 1} first")
        gone, at = self._fs(changed_at)
        gone.delete(at, True)
        unchanged = sums[0] - many
        return Scan(n + 1, many - sums[1], sums[1], unchanged, before - unchanged)

    def _convert(self, changed: DataFrame, tasks: int) -> DataFrame:
        parsers = self.parsers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["path", "kind", "id", "name", "values", "vertices"]
            for pdf in batches:
                for path in pdf["path"]:
                    try:
                        fs, at = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                        with fs.open_input_stream(at) as f:
                            text = f.read().decode("utf-8", "replace")
                        rows = [(path, *r) for r in parsers[path.rpartition(".")[2].lower()](text)]
                    except Exception as e:  # the manifest lists it; other files go on
                        rows = [(path, "error", -1, f"{type(e).__name__}: {e}"[:500], None, None)]
                    yield pd.DataFrame(rows, columns=names)

        return changed.select("path").repartition(tasks, "path").mapInPandas(run, meshes.SCHEMA)

    def rows(self) -> DataFrame:
        """The rows of all files of the manifest that were converted."""
        known = self.manifest().filter("error is null").select("path", "batch")
        fs, where = self._fs(f"{self.root}/rows")
        if not fs.exists(where):
            return self.spark.createDataFrame([], meshes.SCHEMA)
        every = self.spark.read.schema(meshes.SCHEMA + ", batch string").parquet(f"{self.root}/rows")
        return every.join(known, ["path", "batch"]).drop("batch")

    def failures(self) -> DataFrame:
        return self.manifest().filter("error is not null").select("path", "error")


def case_set(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(path, n_points, n_cells, coordinate_hash, topology_hash, same_as): the meshes of converted cases, each with the first case of the same mesh.

    All cases must have the same fields: names, places and numbers of components; else ValueError.
    """
    fields = rows.filter("kind = 'field'").select("path", "name", F.size("values").alias("n")).distinct()
    contract = fields.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "n"))), ",").alias("fields"))
    each = rows.select("path").distinct().join(contract, "path", "left").fillna("", ["fields"])
    if each.select("fields").distinct().limit(2).count() > 1:
        raise ValueError("cases differ in their fields")
    v = F.col("values")
    points = rows.filter("kind = 'point'").select("path", "id", v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))
    cells = rows.filter("kind = 'cell'").select("path", "vertices")
    return mesh_classes(mesh_hashes(points, cells, "path", "id", ["x", "y", "z"], "vertices", tolerance), "path")
