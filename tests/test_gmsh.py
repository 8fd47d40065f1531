"""Gmsh meshes of both formats, small and split."""

import numpy as np
import pytest

from fieldloom.sources import gmsh, meshes

OLD = """$MeshFormat
2.2 0 8
$EndMeshFormat
$Nodes
3
1 0 0 0
5 1 0 0
9 0 1 0.5
$EndNodes
$Elements
2
1 2 2 7 1 1 5 9
2 1 2 7 1 5 9
$EndElements
"""
NEW = """$MeshFormat
4.1 0 8
$EndMeshFormat
$Entities
1 0 0 0
1 0 0 0 0
$EndEntities
$Nodes
3 5 1 9
0 1 0 1
1
0 0 0
1 1 1 2
5
6
1 0 0 1
2 0 0 2
2 1 0 2
8
9
0 1 0.5
1 1  0.25
$EndNodes
$Elements
2 5 1 5
2 1 2 3
1 1 5 8
2 5 6 8
3 6 9 8
1 4 1 2
4 1 5
5 5 99
$EndElements
"""


def _read(spark, folder):
    m = gmsh.read_gmsh(spark, str(folder))
    return sorted((r.point_id, r.x, r.y, r.z) for r in m["points"].collect()), sorted((r.cell_id, r.cell_type, r.vertex_ids) for r in m["cells"].collect())


def test_format_2_as_the_whole_text_reader_has_it(spark, tmp_path):
    (tmp_path / "a.msh").write_text(OLD)
    points, cells = _read(spark, tmp_path)
    rows = list(meshes.parse_gmsh(OLD))
    assert points == [(i, *v) for k, i, _, v, _ in rows if k == "point"]
    assert cells == [(i, int(n), v) for k, i, n, _, v in rows if k == "cell"]


def test_format_4_with_parameters_and_misleading_lines(spark, tmp_path):
    (tmp_path / "a.msh").write_text(NEW)
    points, cells = _read(spark, tmp_path)
    assert points == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 2, 0, 0), (3, 0, 1, 0.5), (4, 1, 1, 0.25)]
    assert cells == [(0, 2, [0, 1, 3]), (1, 2, [1, 2, 3]), (2, 2, [2, 4, 3]), (3, 1, [0, 1]), (4, 1, [1, None])]


def test_a_file_split_over_tasks_and_both_formats_together(spark, tmp_path):
    n = 3000
    xyz = np.random.default_rng(1).normal(size=(n, 3)).round(6)
    half = n // 2
    out = ["$MeshFormat", "4.1 0 8", "$EndMeshFormat", "$Nodes", f"2 {n} 1 {n}"]
    for lo, hi in ((0, half), (half, n)):
        out += [f"2 {lo + 1} 0 {hi - lo}", *(str(i + 1) for i in range(lo, hi)), *(" ".join(map(repr, map(float, xyz[i]))) for i in range(lo, hi))]
    out += ["$EndNodes", "$Elements", f"1 {n - 2} 1 {n - 2}", f"2 1 2 {n - 2}", *(f"{i + 1} {i + 1} {i + 2} {i + 3}" for i in range(n - 2)), "$EndElements"]
    (tmp_path / "big.msh").write_text("\n".join(out) + "\n")
    (tmp_path / "old.msh").write_text(OLD)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        m = meshes.read_mesh(spark, str(tmp_path / "*.msh"))
        points = m["points"].filter("path LIKE '%big.msh'").orderBy("point_id").collect()
        cells = m["cells"].filter("path LIKE '%big.msh'").orderBy("cell_id").collect()
        others = m["points"].filter("path LIKE '%old.msh'").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert np.array_equal([[r.x, r.y, r.z] for r in points], xyz) and [r.point_id for r in points] == list(range(n)) and others == 3
    assert [r.vertex_ids for r in cells] == [[i, i + 1, i + 2] for i in range(n - 2)]


@pytest.mark.parametrize("text", ["GRID 1\n", NEW.replace("4.1 0 8", "4.1 1 8"), NEW.replace("4.1 0 8", "3 0 8")])
def test_what_is_no_such_mesh(spark, tmp_path, text):
    (tmp_path / "a.msh").write_text(text)
    with pytest.raises(ValueError, match="not an ASCII Gmsh mesh"):
        gmsh.read_gmsh(spark, str(tmp_path))
