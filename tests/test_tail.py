import pytest

from fieldloom.sources import tail as T


def run(spark, tmp_path, name, **options):
    stream = T.tail(spark, f"{tmp_path}/logs/*.log", **options)
    return stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-cp").option("path", f"{tmp_path}/{name}").start()


def lines(spark, tmp_path, name):
    rows = spark.read.schema(T.SCHEMA).parquet(f"{tmp_path}/{name}").collect()
    return sorted((r.path.rsplit("/", 1)[1], r.at, r.line) for r in rows)


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_appended_lines_come_once_and_whole(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    append(logs / "a.log", b"one\ntw")
    append(logs / "other.txt", b"not this\n")
    q = run(spark, tmp_path, "all", start="earliest", range_bytes=5)
    try:
        q.processAllAvailable()
        assert lines(spark, tmp_path, "all") == [("a.log", 0, "one")]
        append(logs / "a.log", "o é\nthree\r\nfo".encode())
        append(logs / "b.log", b"\n\nb\xff\n")
        q.processAllAvailable()
    finally:
        q.stop()
    want = [("a.log", 0, "one"), ("a.log", 4, "two é"), ("a.log", 11, "three"), ("b.log", 0, ""), ("b.log", 1, ""), ("b.log", 2, "b�")]
    assert lines(spark, tmp_path, "all") == want
    # While the query is down a line is completed and a long one appended; after the restart each comes once.
    append(logs / "a.log", b"ur\n" + b"x" * 10_000 + b"\nhalf")
    q = run(spark, tmp_path, "all", start="earliest", range_bytes=3000)
    try:
        q.processAllAvailable()
        assert lines(spark, tmp_path, "all") == sorted(want + [("a.log", 18, "four"), ("a.log", 23, "x" * 10_000)])
        (logs / "b.log").write_bytes(b"n\n")  # cut and begun anew
        q.processAllAvailable()
    finally:
        q.stop()
    assert lines(spark, tmp_path, "all") == sorted(want + [("a.log", 18, "four"), ("a.log", 23, "x" * 10_000), ("b.log", 0, "n")])


def test_latest_skips_what_is_there(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    append(logs / "a.log", b"old\nha")
    q = run(spark, tmp_path, "new")
    try:
        q.processAllAvailable()
        append(logs / "a.log", b"lf\n")
        append(logs / "c.log", b"new\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert lines(spark, tmp_path, "new") == [("a.log", 4, "half"), ("c.log", 0, "new")]


def test_every_split_gives_the_same_lines(tmp_path):
    data = b"a\n\nbcd\n" + b"e" * 9000 + b"\nf\n"
    path = tmp_path / "x.log"
    path.write_bytes(data + b"half")
    for size in (1, 2, 3, 7, 100, 9004, 1 << 20):
        stream = T.TailStream({"path": str(path), "rangebytes": size if size > 3 else 4097 * size})
        parts = stream.partitions({"ends": {}}, stream.latestOffset())
        got = [(a, x) for p in parts for b in stream.read(p) for a, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        assert got == [(0, "a"), (2, ""), (3, "bcd"), (7, "e" * 9000), (9008, "f")]
    with pytest.raises(ValueError):
        T.TailStream({"path": "x", "start": "now"})
