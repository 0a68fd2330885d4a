import struct

from pyspark.sql import functions as F

from plinth.runtime import Stage
from plinth.sources import files, sinks
from plinth.streaming import control, windows


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_raw_pages(spark, tmp_path):
    pages = ", ".join('{"page_number": %d, "content": "碳纤维复合材料"}' % i for i in range(1, 101))
    (tmp_path / "b.json").write_text('{"file_name": "b", "file_path": "x/books/b.json", "pages": [%s]}' % pages)
    got = files.raw_pages(files.read_json(spark, str(tmp_path / "b.json"), files.RAW_DOCUMENT), 10)
    assert got.count() == 10 and got.first()["language"] == "zh" and got.first()["source_folder"] == "books"


def test_images_and_hashes(spark, tmp_path):
    (tmp_path / "12_fibres").mkdir()
    (tmp_path / "12_fibres/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20) + b"\0" * 9)
    (tmp_path / "12_fibres/b.txt").write_text("x")
    r = files.scan_images(spark, str(tmp_path)).collect()
    assert [(x["format"], x["width"], x["height"], x["folder_no"]) for x in r] == [("png", 30, 20, 12)]
    assert files.file_hashes(spark, str(tmp_path)).count() == 2


def test_links_and_conversion(spark, tmp_path):
    html = """<a class="x iusc" m='{"murl": "http://a/b.jpg", "t": "T"}'>i</a><a class="iusc" m="broken">j</a><a href="http://c">k</a><p>"""
    df = spark.createDataFrame([(1, html), (2, None)], "id bigint, html string")
    assert [(r["url"], r["title"]) for r in files.page_links(df, "id", "html").orderBy("place").collect()] == [("http://a/b.jpg", "T"), ("http://c", None)]
    (tmp_path / "a.txt").write_text("one\n\n two \n\n\n")
    (tmp_path / "b.pdf").write_text("x")
    rows = files.convert(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in rows if r["text"]) == ["one", "two"] and [r["error"] for r in rows if r["error"]] == ["no extractor for pdf"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", 1), ("a", 2), ("b", None)], "k string, v int")
    sinks.route(df, {"one": F.col("v") == 1, "some": F.col("v") > 0}, str(tmp_path / "r"))
    assert {r["route"]: r["n"] for r in spark.read.json(str(tmp_path / "r")).groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()} == {"one": 1, "some": 1, "rest": 1}
    rows, ids = sinks.versioned(Stage(spark, "t"), df, "k", ["k"], "item")
    assert {r["old_id"]: r["new_id"] for r in ids.collect()} == {"a": "item_0000", "b": "item_0001", "c": "item_0002"} and "k" in rows.columns
    sinks.write_report(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    (src / "1.json").write_text('{"ts": "2024-01-01T00:01:00Z", "k": "a"}\n{"ts": "2024-01-01T00:04:00Z", "k": "a"}\n')
    (src / "2.json").write_text('{"ts": "2024-01-01T01:00:00Z", "k": "b"}\n')
    stream = files.log_stream(spark, str(src), "ts timestamp, k string")
    q = windows.tumbling(stream, "ts", "5 minutes", ["k"], {"n": F.count(F.lit(1))}, late="1 minute").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.tumbling(spark.read.schema("ts timestamp, k string").json(str(src)), "ts", "5 minutes", ["k"], {"n": F.count(F.lit(1))})
    assert sorted(spark.table("w").collect()) == sorted(batch.collect())


def test_state(spark, tmp_path):
    src = tmp_path / "t"
    src.mkdir()
    (src / "1.json").write_text("".join('{"variant": "v", "ordinal": %d, "good": %s}\n' % (i, g) for i, g in enumerate(["true", "true", "false"])))
    q = control.trust_updates(files.log_stream(spark, str(src), "variant string, ordinal bigint, good boolean")).writeStream.format("memory").queryName("trust").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [round(r["trust"], 6) for r in spark.table("trust").collect()] == [0.55]


def test_worker_levels(spark):
    df = spark.createDataFrame([(1, 100, 10), (2, 100, 1), (3, 5, 5)], "s bigint, n bigint, errors bigint").select(F.timestamp_seconds("s").alias("start"), "n", "errors")
    assert [r["workers"] for r in control.worker_levels(df, 20).orderBy("start").collect()] == [8, 10, 10]
