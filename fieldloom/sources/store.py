"""A field store: points, cells and time-partitioned fields as Parquet, with a JSON manifest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2.0"


class FieldStore:
    """Snapshots under one path; reads of a time step or field prune partitions and columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write_mesh(self, points: DataFrame, cells: DataFrame) -> None:
        points.write.mode("overwrite").parquet(f"{self.path}/points")
        cells.write.mode("overwrite").parquet(f"{self.path}/cells")
        self.spark.createDataFrame([(VERSION,)], "version string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")

    def append_snapshot(self, fields: DataFrame, time_index: int, time: float) -> None:
        """fields: (field, entity_id, value)."""
        fields.withColumns({"time_index": F.lit(time_index), "time": F.lit(float(time))}).write.mode("append").partitionBy("time_index", "field").parquet(f"{self.path}/fields")

    def fields(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fields")

    def read_timestep(self, time_index: int, field: str | None = None) -> DataFrame:
        out = self.fields().filter(F.col("time_index") == time_index)
        return out if field is None else out.filter(F.col("field") == field)

    def time_steps(self) -> DataFrame:
        return self.fields().select("time_index", "time").distinct().orderBy("time_index")

    def field_names(self) -> DataFrame:
        return self.fields().select("field").distinct().orderBy("field")
