from sedimark.sources import blobs as S
from sedimark.sources import settings
from sedimark.streaming import ingest


def test_files_and_limits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    (tmp_path / "in/b.bin").write_bytes(b"x" * 100)
    rows = S.from_files(spark, str(tmp_path / "in"), limit=50).collect()
    assert [(r.file_name, bytes(r.content)) for r in rows] == [("a.bin", b"abc")]


def test_uploads(spark):
    fields = spark.createDataFrame(
        [(1, 0, "file", None, b"tiny"), (1, 1, "note", "n.txt", b""), (1, 2, "x", None, b"longer than ten"), (2, 0, "x", None, b"short"), (3, 0, "file", "a", b"1"), (3, 1, "file", "b", b"2")],
        "request int, pos int, name string, filename string, content binary",
    )
    found = {r.request: r for r in S.single_uploads(fields).collect()}
    assert (found[1].file_name, bytes(found[1].content)) == ("n.txt", b"longer than ten") and found[2].error == "empty_file" and found[3].file_name == "b"
    pairs = {r.request: r for r in S.pair_uploads(fields).collect()}
    assert pairs[3].first.file_name == "a" and pairs[3].error is None and pairs[1].error == pairs[2].error == "invalid_input"
    assert {r.total_fields for r in S.field_profile(fields).collect()} == {3, 1, 2}


def test_stores(spark):
    changes = spark.createDataFrame([(1, "b", "1"), (2, "a", "2"), (3, "b", "3"), (4, "c", "4"), (5, "c", None)], "pos int, key string, value string")
    assert [tuple(r) for r in settings.settings(changes).collect()] == [("a", "2"), ("b", "3")]


def test_stream_reads_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"version: 1.2.3 of a file"), ("b.txt", b"version: 1.2.3 of a file"), ("c.txt", b"another file, MIT licence text")):
        (tmp_path / "in" / name).write_bytes(data)
    files = ingest.described(ingest.stream_files(spark, str(tmp_path / "in"), 1 << 20))
    ingest.write(files, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and sorted(r.kind for r in rows) == ["tiny", "tiny"]


def test_profile_of_odd_fields(spark):
    fields = spark.createDataFrame([(1, 0, None, "f", "text/plain", "é".encode() * 60), (1, 1, "b", None, None, b"a\xffb")], "request int, pos int, name string, filename string, content_type string, content binary")
    rows = {r.pos: r for r in S.field_profile(fields).collect()}
    assert (rows[0].name, rows[0].content_type, rows[0].preview) == ("unknown", "text/plain", "é" * 50 + "... (truncated)")
    assert (rows[1].preview, rows[1].content_type, rows[1].total_fields) == ("a�b", None, 2)
