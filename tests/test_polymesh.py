"""OpenFOAM meshes: a row of boxes, written as the format has it."""

import pytest

from fieldloom.sources import polymesh

HEAD = "/* a banner */\nFoamFile\n{{\n    version 2.0;\n    format {form};\n    class {kind};\n    object {name};\n}}\n// * * //\n\n"


def _write(folder, name, kind, entries, short=False, form="ascii"):
    body = f"{len(entries)}({' '.join(entries)})\n" if short else f"{len(entries)}\n(\n" + "\n".join(entries) + "\n)\n"
    (folder / name).write_text(HEAD.format(form=form, kind=kind, name=name) + body + "\n// * * //\n")


def _boxes(folder, n, width=1.0):
    """n boxes of width x 1 x 1 in a row along x."""
    folder.mkdir(parents=True)
    points = [f"({i * width} {y} {z})" for i in range(n + 1) for y, z in ((0, 0), (1, 0), (1, 1), (0, 1))]
    ring = lambda i: [4 * i + k for k in range(4)]
    inner = [(ring(i + 1), i, i + 1) for i in range(n - 1)]
    ends = [(ring(0)[::-1], 0), (ring(n), n - 1)]
    walls = [([4 * i + k, 4 * i + (k + 1) % 4, 4 * i + 4 + (k + 1) % 4, 4 * i + 4 + k], i) for i in range(n) for k in range(4)]
    text = lambda v: f"{len(v)}({' '.join(map(str, v))})"
    _write(folder, "points", "vectorField", points, short=n == 1)
    _write(folder, "faces", "faceList", [text(v) for v, *_ in inner + ends + walls])
    _write(folder, "owner", "labelList", [str(f[1]) for f in inner + ends + walls], short=n == 1)
    _write(folder, "neighbour", "labelList", [str(f[2]) for f in inner])
    patches = (("ends", "patch", len(inner), 2), ("walls", "wall", len(inner) + 2, 4 * n), ("none", "empty", 0, 0))
    _write(folder, "boundary", "polyBoundaryMesh", [f"{p}\n{{\n type {t};\n nFaces {c};\n startFace {s};\n}}" for p, t, s, c in patches])


def test_boxes_in_a_row(spark, tmp_path):
    _boxes(tmp_path / "a" / "polyMesh", 60)
    _boxes(tmp_path / "b" / "polyMesh", 1, width=2.5)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        mesh = polymesh.read_poly_mesh(spark, str(tmp_path / "*" / "polyMesh"))
        cells = {(r.mesh[-10:-9], r.cell_id): r for r in mesh["cells"].collect()}
        geometry = {(r.mesh[-10:-9], r.cell_id): r for r in polymesh.cell_geometry(mesh).collect()}
        faces = mesh["faces"].filter("mesh LIKE '%a/polyMesh'").orderBy("face_id").collect()
        patches = {(r.mesh[-10:-9], r.patch): (r.type, r.first, r.n) for r in mesh["patches"].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(cells) == set(geometry) == {("a", i) for i in range(60)} | {("b", 0)}
    for (m, i), r in cells.items():
        assert r.vertex_ids == list(range(4 * i, 4 * i + 8)) and len(r.face_ids) == 6
        g, w = geometry[(m, i)], 1.0 if m == "a" else 2.5
        assert g.volume == pytest.approx(w) and g.surface == pytest.approx(2 + 4 * w) and g.openness == pytest.approx(0, abs=1e-12)
    assert [(f.owner, f.neighbour, f.patch) for f in faces[:59]] == [(i, i + 1, None) for i in range(59)]
    assert [f.patch for f in faces[59:]] == ["ends"] * 2 + ["walls"] * 240 and all(f.neighbour is None for f in faces[59:])
    assert patches[("b", "walls")] == ("wall", 2, 4) and patches[("a", "none")] == ("empty", 0, 0)


def test_binary_lists_are_refused(spark, tmp_path):
    _boxes(tmp_path / "polyMesh", 2)
    _write(tmp_path / "polyMesh", "points", "vectorField", ["x"], form="binary")
    with pytest.raises(ValueError, match="binary"):
        polymesh.read_poly_mesh(spark, str(tmp_path / "polyMesh"))
