import os

import pytest

from fieldloom.sources import ingest as I

MESH = "NDIME= 2\nNELEM= 1\n5 {0} {1} {2} 0\nNPOIN= 3\n{3}\nNMARK= 0\n"


def mesh(order=(0, 1, 2), move=0.0):
    points = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0 + move)]
    lines = [f"{points[k][0]} {points[k][1]} {i}" for i, k in enumerate(order)]
    at = {k: i for i, k in enumerate(order)}
    return MESH.format(at[0], at[1], at[2], "\n".join(lines))


def write(path, text, when):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (when, when))


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").distinct().collect())


def test_only_changed_files_are_converted(spark, tmp_path):
    src = tmp_path / "cases"
    for i, name in enumerate(("a", "b", "deep/c")):
        write(src / f"{name}.su2", mesh(), 1_700_000_000 + i)
    write(src / "broken.vtk", "no mesh at all", 1_700_000_000)
    write(src / "notes.xyz", "?", 1_700_000_000)
    cache = I.MeshCache(spark, f"file://{tmp_path}/cache")
    assert cache.version() == 0 and cache.rows().count() == 0
    assert cache.scan(f"file://{src}") == (1, 3, 2, 0, 0)
    assert names(cache.rows()) == ["a.su2", "b.su2", "c.su2"]
    assert {r.path.rsplit("/", 1)[1]: r.error.split(":")[0] for r in cache.failures().collect()} == {"broken.vtk": "ValueError", "notes.xyz": "KeyError"}
    before = sorted(map(str, cache.rows().collect()))

    assert cache.scan(f"file://{src}") == (2, 0, 0, 5, 0)
    assert sorted(map(str, cache.rows().collect())) == before

    write(src / "b.su2", mesh(move=0.5), 1_700_000_500)
    assert cache.scan(f"file://{src}") == (3, 1, 0, 4, 1)
    b = [r for r in cache.rows().filter("kind = 'point'").collect() if r.path.endswith("b.su2")]
    assert sorted(r["values"][1] for r in b) == [0.0, 0.0, 1.5]

    (src / "a.su2").unlink()
    write(src / "broken.vtk", "still none", 1_700_000_900)
    assert cache.scan(f"file://{src}") == (4, 0, 1, 3, 2)
    assert names(cache.rows()) == ["b.su2", "c.su2"]


def test_a_scan_that_comes_second_fails_and_changes_nothing(spark, tmp_path, monkeypatch):
    src = tmp_path / "cases"
    write(src / "a.su2", mesh(), 1_700_000_000)
    first, second = (I.MeshCache(spark, f"file://{tmp_path}/cache") for _ in range(2))
    monkeypatch.setattr(second, "version", lambda: 0)
    first.scan(f"file://{src}", "*.su2")
    with pytest.raises(RuntimeError):
        second.scan(f"file://{src}", "*.su2")
    assert first.version() == 1 and names(first.rows()) == ["a.su2"] and first.rows().filter("kind = 'point'").count() == 3


def test_cases_with_the_same_mesh(spark, tmp_path):
    src = tmp_path / "cases"
    write(src / "a.su2", mesh(), 1_700_000_000)
    write(src / "b.su2", mesh((2, 0, 1)), 1_700_000_000)
    write(src / "c.su2", mesh(move=0.1), 1_700_000_000)
    cache = I.MeshCache(spark, f"file://{tmp_path}/cache")
    cache.scan(f"file://{src}")
    got = {r.path[-5:]: (r.n_points, r.n_cells, r.same_as[-5:]) for r in I.case_set(cache.rows()).collect()}
    assert got == {"a.su2": (3, 1, "a.su2"), "b.su2": (3, 1, "a.su2"), "c.su2": (3, 1, "c.su2")}
    rows = cache.rows()
    one = rows.limit(1).selectExpr("path", "'field' as kind", "0L as id", "'cell:p' as name", "array(1.0D) as values", "cast(null as array<long>) as vertices")
    with pytest.raises(ValueError):
        I.case_set(rows.unionByName(one))
