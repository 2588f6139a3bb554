from __future__ import annotations

import io
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from glucoframe.llm import warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, pages, folder, **more):
    written = warc.write_archives(pages, f"file://{folder}", **more)
    return written, warc.read_archives(spark, f"file://{folder}", written, with_payload=True)


def test_pages_round_trip(spark, docs_folder, tmp_path):
    pages = spark.read.parquet(f"{docs_folder}/pages.parquet")
    written, records = round_trip(spark, pages, tmp_path)
    html = {r.page_id: r.html for r in pages.collect()}
    found = records.collect()
    assert {r.page_id: r.payload.decode() for r in found} == html
    assert all(r.payload_digest == warc.base32_sha1(r.payload) and r.payload_bytes == len(r.payload) for r in found)
    for row in written.collect():
        with open(tmp_path / row.archive, "rb") as file:
            data = file.read()
        magic, size = struct.unpack("<II", data[:8])
        dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        assert magic == warc.DICTIONARY_MAGIC
        with pytest.raises(zstandard.ZstdError):  # the records need it
            zstandard.ZstdDecompressor().decompress(data[8 + size :])
        assert len(list(warc.frames(io.BytesIO(data)))) == row.records + 1
        plain = zstandard.ZstdCompressor(level=warc.LEVEL)
        alone = sum(len(plain.compress(f)) for f in warc.frames(io.BytesIO(data)))
        assert len(data) - size < alone and zstandard.ZstdCompressionDict(dictionary).dict_id()
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]


def test_revisits_and_odd_rows(spark, tmp_path):
    long_page = "<p>x</p>" * 300_000
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (1, "a\r\nb: c", None), (3, "u", ""), (None, "n", "same"), (4, "u4", long_page), (7, "u7", long_page), (8, "ü", "other"), (8, "ü", "other")]
    pages = spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("first"), F.lit(2).alias("sha"), F.lit("x").alias("payload"), F.lit(1).alias("key")).repartition(3)
    _, records = round_trip(spark, pages, tmp_path / "all")
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in records.collect()}
    assert found == {
        (2, "response", None, 4), (5, "revisit", 2, 4), (9, "revisit", 2, 4), (None, "revisit", 2, 4), (1, "response", None, 0), (3, "revisit", 1, 0),
        (4, "response", None, len(long_page)), (7, "revisit", 4, len(long_page)), (8, "response", None, 5),
    }
    assert records.count() == 10
    _, records = round_trip(spark, pages, tmp_path / "some", min_bytes=5)
    assert {r.page_id for r in records.collect() if r.record_type == "revisit"} == {7}
    written, records = round_trip(spark, spark.createDataFrame([], PAGES), tmp_path / "none")
    assert written.count() == 0 and records.count() == 0


def test_archives_roll_over_and_damage_is_noticed(spark, tmp_path, monkeypatch):
    archive = warc._Archive(warc.pafs.LocalFileSystem(), str(tmp_path), "one.warc.zst", warc.EMPTY_DATE, 0)
    for k in range(200):
        archive.add(warc.page_record(k, f"http://x/{k}", f"<p>page {k} {k * k}</p>".encode() * 20, None, False, warc.EMPTY_DATE))
    archive.close()
    data = (tmp_path / "one.warc.zst").read_bytes()
    assert len(list(warc.frames(io.BytesIO(data)))) == 201
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
