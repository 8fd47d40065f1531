import io
import zipfile

import pytest

from fieldloom.llm import warc

PAGES = [(1, "http://a/ b\n", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "u", None), (2, "u", ""), (7, "u", "é" * 100_000), (None, "u", "solo"), (8, "u", "dup"), (8, "u", "dup"), (6, "u", "dup")]


def expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(same, default=None)
        revisit = top is not None and i != top
        out.append((i, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 26, 200])
def test_round_trip(spark, size, monkeypatch):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string")
    folder = warc.scratch_path(spark, "t")
    got = warc.read_packages(warc.write_packages(warc.with_revisits(df), folder, package_bytes=size), slice_records=2).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES)
    by_id = {r.page_id: r for r in got}
    assert bytes(by_id[7].payload).decode() == "é" * 100_000 and by_id[5].target_uri == "http://b" and by_id[1].target_uri == "http://a/%20b%0A"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df, spark).count() == 0


def test_directories_of_other_writers(tmp_path, monkeypatch):
    """Central and ZIP64 directories as the standard library writes them, comments, and members that are not stored."""
    data, about = warc.record(9, "u", b"payload", None, "1970-01-01T00:00:00Z")
    z = warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31)
    packed = z.compress(data) + z.flush()
    for zip64 in (False, True):
        p = tmp_path / f"{zip64}.zip"
        with zipfile.ZipFile(p, "w") as f:
            for i in range(70_000 if zip64 else 3):  # over 65,535 entries need ZIP64
                f.writestr(f"pad/{i}", b"")
            with f.open(warc.DATA, "w", force_zip64=zip64) as d:
                d.write(packed)
            f.writestr(warc.INDEX, warc.json.dumps(about | {"offset": 0, "length": len(packed)}))
            f.writestr("deflated", b"x" * 999, zipfile.ZIP_DEFLATED)
            f.comment = b"PK" * 50
        reader = warc.PackageReader(f"file://{p}")
        ((_, got),) = reader.records(reader.index())
        assert warc.parse_record(got)["payload"] == b"payload"
        with pytest.raises(ValueError, match="compressed"):
            reader.member("deflated")
    (tmp_path / "cut").write_bytes(p.read_bytes()[:-400_000])
    with pytest.raises(ValueError):
        warc.PackageReader(f"file://{tmp_path / 'cut'}")
