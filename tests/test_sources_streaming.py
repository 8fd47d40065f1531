import pytest
from pyspark.sql import functions as F

from fieldloom.sources import meshes
from fieldloom.sources.store import FieldStore
from fieldloom.streaming import sensors

SU2 = """% square
NDIME= 2
NELEM= 2
5 0 1 2 0
5 0 2 3 1
NPOIN= 4
0.0 0.0 0
1.0 0.0 1
1.0 1.0 2
0.0 1.0 3
NMARK= 1
MARKER_TAG= rim
MARKER_ELEMS= 2
3 0 1
3 1 2
"""
VTK = """# vtk DataFile Version 3.0
tet
ASCII
DATASET UNSTRUCTURED_GRID
POINTS 4 float
0 0 0 1 0 0
0 1 0 0 0 1
CELLS 1 5
4 0 1 2 3
CELL_TYPES 1
10
POINT_DATA 4
SCALARS p float 1
LOOKUP_TABLE default
1 2 3 4
VECTORS U float
1 0 0 0 1 0 0 0 1 1 1 1
"""
FOAM = 'FoamFile\n{\n class volVectorField;\n object U;\n}\ninternalField nonuniform List<vector> 2((1 0 0) (0 2 0));\nboundaryField\n{\n walls\n {\n type fixedValue;\n }\n}\n'
FLUENT = '(0 "grid")\n(2010 (0 1 2 3)\n(\n0 0 0\n1 0 0\n))\n(0 "Pressure field p")\n(3010 (2 1 2 1 1)\n(\n5.0\n6.0\n))\n(2040 (2 0 0 6)\n"wall")\n'
GMSH = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n3\n1 0 0 0\n5 1 0 0\n7 0 1 0\n$EndNodes\n$Elements\n1\n1 2 2 0 1 1 5 7\n$EndElements\n"


@pytest.mark.parametrize("name,text,points,cells,fields", [("a.su2", SU2, 4, 2, 0), ("a.vtk", VTK, 4, 1, 8), ("a.foam", FOAM, 0, 0, 2), ("a.dat", FLUENT, 2, 0, 2), ("a.msh", GMSH, 3, 1, 0)])
def test_meshes(spark, tmp_path, name, text, points, cells, fields):
    (tmp_path / name).write_text(text)
    got = meshes.read_mesh(spark, str(tmp_path / name))
    assert (got["points"].count(), got["cells"].count(), got["fields"].count()) == (points, cells, fields)
    if name == "a.vtk":
        assert {r.entity_id: r.value[0] for r in got["fields"].filter("field = 'p'").collect()} == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}
    if name == "a.msh":
        assert got["cells"].first().vertex_ids == [0, 1, 2]


def test_wrong_files_are_refused(spark, tmp_path):
    for parse, text in ((meshes.parse_su2, "x"), (meshes.parse_vtk, "x"), (meshes.parse_fluent, "x"), (meshes.parse_gmsh, "GRID 1\n"), (meshes.parse_foam, "x")):
        with pytest.raises(ValueError):
            list(parse(text))
    with pytest.raises(ValueError):
        meshes.read_mesh(spark, str(tmp_path / "a.cgns"))


def test_csv_snapshots(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("x,U\n" + "".join(f"{i},{i * (k + 1)}\n" for i in range(5)))
    paths = [str(tmp_path / f"{k}.csv") for k in range(3)]
    got = {(r.file_idx, r.point_id): r.value for r in meshes.csv_snapshots(spark, paths, "U").collect()}
    assert got == {(k, i): float(i * (k + 1)) for k in range(3) for i in range(5)}
    with pytest.raises(KeyError):
        meshes.csv_snapshots(spark, paths, "V")
    (tmp_path / "2.csv").write_text("x,U\n0,1\n")
    with pytest.raises(ValueError):
        meshes.csv_snapshots(spark, paths, "U")


def test_field_store(spark, tmp_path):
    store = FieldStore(spark, str(tmp_path / "case"))
    store.write_mesh(spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double"), spark.createDataFrame([(0, 1, [0])], "cell_id long, cell_type int, vertex_ids array<long>"))
    for k in range(2):
        store.append_snapshot(spark.createDataFrame([("p", 0, [float(k)]), ("U", 0, [1.0, 2.0, 3.0])], "field string, entity_id long, value array<double>"), k, k / 10)
    assert store.read_timestep(1, "p").first().value == [1.0]
    assert [r.field for r in store.field_names().collect()] == ["U", "p"] and store.time_steps().count() == 2


def test_upsert_rules(spark):
    rows = [("a", 1.0, [1.0], "good", 2, 0), ("a", 1.0, [2.0], "good", 1, 1), ("b", 1.0, [1.0], "good", 2, 0), ("b", 1.0, [2.0], "good", None, 1), ("c", 1.0, [1.0], "bad", 1, 0), ("d", 1.0, [1.0], "good", None, 0), ("d", 1.0, [2.0], "good", 5, 1)]
    got = {r.sensor_id: r["values"][0] for r in sensors.upserted(spark.createDataFrame(rows, sensors.SAMPLE + ", arrival_id long"), "arrival_id").collect()}
    assert got == {"a": 1.0, "b": 2.0, "d": 2.0}


def test_payloads(spark):
    df = spark.createDataFrame([('{"sensor_id":"s","timestamp":1.5,"values":[1,2]}',), ("2.0,3.0,x",), ("bad",), ("",)], "m string")
    got = [(r.sensor_id, r.timestamp, r["values"]) for r in sensors.decoded(df, "m", "dflt").collect()]
    assert got == [("s", 1.5, [1.0, 2.0]), ("dflt", 2.0, [3.0, None])]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a" if i % 2 else "b", float(i), float(i * i % 7)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "sensor string, t double, x double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("sensor string, t double, x double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = sensors.kalman_stream(stream, "sensor", "t", "x", 0.1, 2.0).writeStream.format("memory").queryName("kf").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("kf").groupBy("sensor").agg(F.count("*").alias("n"), F.max_by("state", "t").alias("s")).collect()
    for r in got:
        m, p = 0.0, 1e3
        for _, _, x in [z for z in rows if z[0] == r.sensor]:
            p += 0.1
            g = p / (p + 2.0)
            m, p = m + g * (x - m), (1 - g) * p
        assert r.n == 20 and abs(r.s - m) < 1e-9


def test_windows_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(120).selectExpr("timestamp_seconds(id * 60) ts", "'s' sensor", "cast(id as double) x").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, sensor string, x double").parquet(str(src))
    q = sensors.windowed(stream, "ts", "sensor", "x").writeStream.format("memory").outputMode("complete").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n, r["mean"]) for r in spark.table("win").collect()) == [(60, 29.5), (60, 89.5)]
