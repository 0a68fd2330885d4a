"""Files into tables: JSON lines, nested page documents, CSV, images, pages of links, any format by a pluggable extractor."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import detect_language

RAW_DOCUMENT = "file_name STRING, file_path STRING, file_size BIGINT, page_count INT, metadata MAP<STRING,STRING>, pages ARRAY<STRUCT<page_number: INT, source: STRING, content: STRING, has_formula_guess: BOOLEAN, clean_content: STRING>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines. A missing path gives no rows; malformed lines are dropped, or fail the job if ``strict``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file that is a single JSON document; a missing path gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def raw_pages(documents: DataFrame, max_pages: int | None = None, sniff: int = 5) -> DataFrame:
    """(file_name, source_folder, page_no, content, has_formula_guess, language) of nested documents.

    The language is that of the first ``sniff`` pages together. Null or empty pages give no rows.
    """
    texts = F.transform(F.slice("pages", 1, sniff), lambda p: F.coalesce(p["clean_content"], p["content"], F.lit("")))
    rows = documents.select("file_name", F.regexp_extract("file_path", r"([^/]+)/[^/]*$", 1).alias("source_folder"), detect_language(F.array_join(texts, " ")).alias("language"), F.posexplode(F.slice("pages", 1, max_pages) if max_pages else F.col("pages")).alias("i", "p"))
    return rows.select("file_name", "source_folder", F.coalesce(F.col("p.page_number"), F.col("i") + 1).alias("page_no"), F.coalesce("p.clean_content", "p.content").alias("content"), "p.has_formula_guess", "language")


def image_header(data: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) of PNG, GIF, JPEG and WebP bytes; nulls if they are none of these."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and data[12:16] == b"VP8X":
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
        return "jpeg", None, None
    return None, None, None


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, folder_no, name, size, format, width, height, sha256) of the images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            heads = [image_header(bytes(c)) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "size": f["length"], "format": [h[0] for h in heads], "width": [h[1] for h in heads], "height": [h[2] for h in heads], "sha256": f["sha256"]}).astype({"width": "Int64", "height": "Int64"})

    out = files.select("path", "length", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(run, "path string, size bigint, format string, width bigint, height bigint, sha256 string").filter("format is not null")
    return out.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("folder_no", F.expr(r"try_cast(nullif(regexp_extract(folder, '^(\\d+)', 1), '') as int)"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, sha256, artifact_id) of files, whole contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.substring(F.md5(F.col("path").cast("binary")), 1, 8).alias("artifact_id"))


class _Items(HTMLParser):
    """Links, and the JSON attribute ``m`` of anchors of class ``iusc``."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag != "a":
            return
        if "iusc" in (a.get("class") or "").split():
            try:
                m = json.loads(a.get("m") or "{}")
            except ValueError:
                return
            url = m.get("murl") or m.get("purl")
            if url:
                self.rows.append((url, m.get("t")))
        elif (a.get("href") or "").startswith("http"):
            self.rows.append((a["href"], a.get("title")))


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, url, title) of the links of each page; broken markup gives what can be read, null none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["html"], strict=True):
                p = _Items()
                p.feed(t or "")
                rows += [(k, i, u, title) for i, (u, title) in enumerate(p.rows)]
            yield pd.DataFrame(rows, columns=["key", "place", "url", "title"])

    src = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return src.mapInPandas(run, f"key {dict(src.dtypes)['key']}, place bigint, url string, title string").withColumnRenamed("key", key)


def plain_text(data: bytes) -> list[str]:
    """Blocks of a text file: parted by blank lines, trimmed, empty ones dropped."""
    return [b.strip() for b in re.split(r"\n\s*\n", data.decode("utf-8", "replace")) if b.strip()]


def html_text(data: bytes) -> list[str]:
    text = re.sub(r"(?is)<(script|style).*?</\1>", " ", data.decode("utf-8", "replace"))
    return plain_text(re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?i)<(?:br|/p|/div|/h\d|/li|/tr)[^>]*>", "\n\n", text)).encode())


#: By suffix; others can be given for formats that need a library or a program.
EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {"txt": plain_text, "md": plain_text, "html": html_text, "htm": html_text}


def convert(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, block_no, text, error): blocks of every file by the extractor of its suffix; what cannot be read is a row with the error."""
    known = EXTRACTORS | (extractors or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                suffix = p.rsplit(".", 1)[-1].lower()
                try:
                    rows += [(p, i, t, None) for i, t in enumerate(known[suffix](bytes(c)))]
                except KeyError:
                    rows.append((p, None, None, f"no extractor for {suffix}"))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["path", "block_no", "text", "error"]).astype({"block_no": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, block_no bigint, text string, error string")


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)
