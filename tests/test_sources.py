import hashlib
import json

from pyspark.sql import functions as F

from reelspark.operators import catalog
from reelspark.sources import readers, writers
from tests.conftest import rows


def test_id_lists_keep_order_and_duplicates(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  s2 \n\ns1\ns2\n")
    (tmp_path / "b.json").write_text('\n ["x", "y"]')
    got = rows(readers.read_id_lists(spark, str(tmp_path)), "list_path", "pos")
    assert [(r[0].rsplit("/", 1)[1], r[1], r[2]) for r in got] == [("a.txt", 0, "s2"), ("a.txt", 1, "s1"), ("a.txt", 2, "s2"), ("b.json", 0, "x"), ("b.json", 1, "y")]


def test_media_listing_and_hashes(spark, tmp_path):
    for name in ("clip.MOV", ".hidden.mov", "x.partial.mp4", "note.txt", "deep/clip.mp4", "deep/other.mkv"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    assert rows(readers.ready_media(spark, str(tmp_path)), "stem") == [("clip",), ("other",)]
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256 for r in readers.hash_files(spark, str(tmp_path)).collect()}
    assert hashes == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.rglob("*") if p.is_file() and p.name in hashes}
    assert hashes["note.txt"] == hashlib.sha256(b"note.txt").hexdigest()


def test_hashes_of_large_files_in_pieces(spark, tmp_path):
    data = bytes(range(256)) * 5000
    (tmp_path / "big.bin").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in readers.hash_files(spark, str(tmp_path), piece_bytes=1 << 16).collect()}
    assert got == {"big.bin": (len(data), hashlib.sha256(data).hexdigest())}


def test_probe_durations(spark):
    doc = {"streams": [{"codec_type": "audio", "sample_rate": "48000"}, {"codec_type": "video", "codec_name": "h264", "width": 8, "height": 4, "avg_frame_rate": "48000/2002", "duration": "2.5"}], "format": {"duration": "3.0"}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"streams": []}))], "render_id int, probe_json string")
    a, b = rows(readers.parse_probe(df).select("has_video", "fps_num", "fps_den", "duration_sec", "has_audio", "sample_rate"))
    assert a == (True, 24000, 1001, 3.0, True, 48000) and b[0] is False
    assert readers.parse_probe(df, "video").first().duration_sec == 2.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, name string")
    writers.write_documents(df, str(tmp_path / "d"), buckets=4)
    writers.write_documents(spark.createDataFrame([(1, "changed"), (3, "c")], df.schema), str(tmp_path / "d"), buckets=4)
    stored = [json.loads(r.document) for r in spark.read.parquet(str(tmp_path / "d")).collect()]
    assert sorted((d["project_id"], d["name"]) for d in stored) == [(1, "changed"), (2, "b"), (3, "c")]
    many = spark.createDataFrame([(i, str(i)) for i in range(40)], df.schema)
    writers.write_documents(many, str(tmp_path / "m"), buckets=2)
    writers.write_documents(many.where("project_id in (3, 4)").withColumn("name", F.lit("new")), str(tmp_path / "m"), buckets=2)
    stored = [json.loads(r.document) for r in spark.read.parquet(str(tmp_path / "m")).collect()]
    assert sorted((d["project_id"], d["name"]) for d in stored) == [(i, "new" if i in (3, 4) else str(i)) for i in range(40)]
    for _ in range(2):
        writers.append_rows(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    writers.replace_table(df, str(tmp_path / "t"), "project_id")
    assert readers.read_table(spark, str(tmp_path / "t")).count() == 2


def test_prefix_resolution_order(spark):
    files = spark.createDataFrame([(1, "abc1", ".mp4", "/b/abc1.mp4"), (0, "abc2", ".mov", "/a/abc2.mov"), (0, "abc10", ".mov", "/a/abc10.mov"), (1, "abc", ".mov", "/b/abc.mov")],
                                  "dir_rank int, stem string, suffix string, path string")
    ids = spark.createDataFrame([("abc",), ("abc1",), ("zz",)], "asset_id string")
    assert rows(catalog.resolve_prefixes(ids, files), "asset_id") == [("abc", "/a/abc10.mov"), ("abc1", "/a/abc10.mov"), ("zz", None)]
