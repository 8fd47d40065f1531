import base64
import zlib

import numpy as np
import pytest

from fieldloom.sources import vtkxml as V

XYZ = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.5], [0.0, 1.0, 0.25], [1.0, 1.0, 1e-3]]
NAMES = {v: k for k, v in V.TYPES.items()}


class Writer:
    """Encodes arrays in one of the format's ways."""

    def __init__(self, way, order="<", head="u4", block=40):
        self.way, self.order, self.head, self.block, self.tail = way, order, head, block, b""

    def array(self, name, values, kind, width=1):
        x = np.array(values, self.order + kind).ravel()
        start = f'<DataArray type="{NAMES[kind]}" Name="{name}" NumberOfComponents="{width}"'
        if self.way == "ascii":
            return f'{start} format="ascii">{" ".join(map(str, x.tolist()))}</DataArray>'
        number = lambda *n: np.array(n, self.order + self.head).tobytes()
        data, raw = x.tobytes(), self.way.endswith("raw")
        code = (lambda b: b) if raw else base64.b64encode
        if "zlib" in self.way:
            parts = [zlib.compress(data[i : i + self.block]) for i in range(0, len(data), self.block)]
            out = code(number(len(parts), self.block, len(data) % self.block, *map(len, parts))) + code(b"".join(parts))
        else:
            out = code(number(len(data)) + data)
        if "appended" not in self.way:
            return f'{start} format="binary">\n{out.decode()}\n</DataArray>'
        offset, self.tail = len(self.tail), self.tail + out
        return f'{start} format="appended" offset="{offset}"/>'

    def file(self, kind, body):
        zipped = ' compressor="vtkZLibDataCompressor"' if "zlib" in self.way else ""
        order = "LittleEndian" if self.order == "<" else "BigEndian"
        head = f'<?xml version="1.0"?>\n<VTKFile type="{kind}" version="1.0" byte_order="{order}" header_type="{NAMES[self.head]}"{zipped}>\n<{kind}>{body}</{kind}>\n'.encode()
        if self.tail:
            how = b"raw" if self.way.endswith("raw") else b"base64"
            head += b'<AppendedData encoding="' + how + b'">\n _' + self.tail + b"\n</AppendedData>\n"
        return head + b"</VTKFile>\n"


def grid(w, shift=0.0):
    points = w.array("Points", np.array(XYZ) + shift, "f8", 3)
    cells = w.array("connectivity", [0, 1, 2, 1, 3, 2, 0, 3], "i8") + w.array("offsets", [3, 6, 8], "i4") + w.array("types", [5, 5, 3], "u1")
    fields = w.array("p", [1.5, 2.5, 3.5, 4.5], "f4"), w.array("U", np.arange(9), "f8", 3)
    piece = f'<Piece NumberOfPoints="4" NumberOfCells="3"><PointData>{fields[0]}</PointData><CellData>{fields[1]}</CellData><Points>{points}</Points><Cells>{cells}</Cells></Piece>'
    return piece


def rows(data):
    return sorted(map(str, V.parse_vtk_xml(data)))


@pytest.mark.parametrize("way", ["ascii", "inline", "inline-zlib", "appended", "appended-zlib", "appended-raw", "appended-zlib-raw"])
@pytest.mark.parametrize("order, head", [("<", "u4"), (">", "u8")])
def test_every_encoding_gives_the_same_rows(way, order, head):
    w = Writer(way, order, head)
    got = list(V.parse_vtk_xml(w.file("UnstructuredGrid", grid(w))))
    assert [r[3] for r in got if r[0] == "point"] == XYZ
    assert [(r[1], r[2], r[4]) for r in got if r[0] == "cell"] == [(0, "5", [0, 1, 2]), (1, "5", [1, 3, 2]), (2, "3", [0, 3])]
    assert [(r[1], r[3]) for r in got if r[2] == "point:p"] == [(0, [1.5]), (1, [2.5]), (2, [3.5]), (3, [4.5])]
    assert [r[3] for r in got if r[2] == "cell:U"] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


def test_pieces_surfaces_and_what_is_not_read():
    w = Writer("inline")
    got = list(V.parse_vtk_xml(w.file("UnstructuredGrid", grid(w) + grid(w, 5.0))))
    assert len([r for r in got if r[0] == "point"]) == 8 and [r[4] for r in got if r[0] == "cell"][3:] == [[4, 5, 6], [5, 7, 6], [4, 7]]
    poly = f'<Piece><Points>{w.array("Points", XYZ, "f4", 3)}</Points><Verts></Verts><Lines>{w.array("connectivity", [0, 1], "i4")}{w.array("offsets", [2], "i4")}</Lines><Polys>{w.array("connectivity", [0, 1, 2, 0, 1, 3, 2], "i4")}{w.array("offsets", [3, 7], "i4")}</Polys></Piece>'
    assert [(r[2], r[4]) for r in V.parse_vtk_xml(w.file("PolyData", poly)) if r[0] == "cell"] == [("3", [0, 1]), ("5", [0, 1, 2]), ("9", [0, 1, 3, 2])]
    for bad in (b"<VTKFile type='ImageData'/>", b"<other/>", b"<VTKFile type='PolyData' compressor='vtkLZ4DataCompressor'/>"):
        with pytest.raises(ValueError):
            list(V.parse_vtk_xml(bad))
    assert list(V.parse_vtk_xml(b"<VTKFile type='PolyData'><PolyData/></VTKFile>")) == []


def test_a_range_of_times_opens_only_its_files(spark, tmp_path):
    entries = []
    for k in range(4):
        w = Writer("appended-zlib-raw")
        (tmp_path / f"s{k}.vtu").write_bytes(w.file("UnstructuredGrid", grid(w, float(k))) if k != 3 else b"broken")
        entries.append(f'<DataSet timestep="{k / 10}" part="0" file="s{k}.vtu"/>')
    (tmp_path / "all.pvd").write_text(f'<?xml version="1.0"?><VTKFile type="Collection"><Collection>{"".join(entries)}</Collection></VTKFile>')
    path = f"file://{tmp_path}/all.pvd"
    assert V.read_collection(spark, path).count() == 4
    got = V.read_times(spark, path, 0.1, 0.2).filter("kind = 'point' and id = 0").collect()
    assert sorted((r.time, r["values"]) for r in got) == [(0.1, [1.0, 1.0, 1.0]), (0.2, [2.0, 2.0, 2.0])]
    assert V.read_times(spark, path, 5.0, 6.0).count() == 0
    with pytest.raises(ValueError):
        V.read_times(spark, path, files_at_most=1)
    assert V.read_vtk_xml(spark, f"file://{tmp_path}/s[01].vtu").filter("kind = 'cell'").count() == 6
