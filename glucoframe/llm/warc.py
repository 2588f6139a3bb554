"""Web archives (WARC) of individually compressed records with a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.llm.common import BROADCAST_ROWS
from glucoframe.session import broadcast_if_small, cut_lineage

# An archive is closed once its records hold this many bytes. Its dictionary comes from its first records.
ARCHIVE_BYTES = 256 << 20
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
READ_BYTES = 1 << 20
# Fixed values of the formats: the skippable frame that holds a dictionary, and the profile of a revisit record.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(record_id: object) -> str:
    return f"<urn:page:{'' if record_id is None else quote(str(record_id), safe='')}>"


def _id(uri: str) -> str | None:
    return unquote(uri[len("<urn:page:") : -1]) or None


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(record_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """One record. A revisit holds the response's headers, whose Content-Length is that of the payload, and no payload."""
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(record_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else quote(c) for c in url)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)))
    if revisit:
        headers += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", SAME_PAYLOAD)]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, http if revisit else http + payload)


def info_record(name: str, date: str) -> bytes:
    fields = b"format: WARC File Format 1.1\r\nconformsTo: https://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{quote(name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], fields)


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records, or None where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


class _Archive:
    """Writes one archive: the dictionary in a leading skippable frame, then a frame for each record.

    Records are held back until the sample for the dictionary is full. The file appears under its name when it is
    complete, so a task that is lost and run again, or runs twice, leaves whole archives only.
    """

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, date: str, attempt: int):
        self.fs, self.path, self.temporary = fs, f"{folder}/{name}", f"{folder}/.{name}.{attempt}.tmp"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.waiting, self.sampled, self.bytes, self.records = [info_record(name, date)], 0, 0, 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.bytes += len(record)
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            self.sampled += len(record)
            if self.sampled >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(record))

    def _begin(self) -> None:
        dictionary = train([r[:SAMPLE_RECORD_BYTES] for r in self.waiting[1:]])
        if dictionary is not None:
            data = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:  # an earlier run of the task got this far
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)


def frames(stream) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time. Raises ValueError where the archive ends inside one."""
    head = stream.read(4)
    dictionary, rest = None, head
    if len(head) == 4 and struct.unpack("<I", head)[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", stream.read(4))[0]
        data = stream.read(size)
        if len(data) >= 4 and struct.unpack("<I", data[:4])[0] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary, rest = zstandard.ZstdCompressionDict(data), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        rest = rest or stream.read(READ_BYTES)
        if not rest:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(READ_BYTES)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, body = record.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    size = int(headers["content-length"])
    if len(body) != size + 4 or not body.endswith(b"\r\n\r\n"):
        raise ValueError("a record's length is not that of its block")
    return headers, body[:size]


def with_revisits(pages: DataFrame, id_column: str, url_column: str, html_column: str, min_bytes: int) -> DataFrame:
    """page_id, url, html and the smallest id among equal payloads (`first`, null where no other page has the payload).

    Payloads are counted by digest (combined before the shuffle); only digests held by several pages are joined back.
    """
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = rows.where(F.octet_length(payload) >= min_bytes).select("page_id", F.sha1(payload.cast("binary")).alias("sha"))
    shared = keyed.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    shared = broadcast_if_small(cut_lineage(shared), BROADCAST_ROWS)
    long_enough = F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload.cast("binary")))
    return rows.withColumn("key", long_enough).join(shared, F.col("key") == F.col("sha"), "left").select("page_id", "url", "html", "first")


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_bytes: int = 0, date: str = EMPTY_DATE,
) -> DataFrame:
    """Write a record for every page below `folder` (a URI) and return (archive, records, bytes) per archive.

    Each task writes its own partition, so nothing is shuffled for the writing, and holds one record and at most the
    sample of one dictionary. Of pages with equal payloads of at least min_bytes bytes, those with the smallest id are
    responses, the others revisit it. Null html: empty payload. Null id: never the smallest unless all are null, then
    all are responses. Repeated rows: those with the smallest id are all responses. Null url: no target header. Further
    columns are ignored; an empty table gives no archives.
    """
    records = with_revisits(pages, id_column, url_column, html_column, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context, archive, number, done = TaskContext.get(), None, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if archive is None:
                        archive = _Archive(fs, root, f"part-{context.partitionId():05d}-{number:05d}.warc.zst", date, context.taskAttemptId())
                    revisit = row["first"] is not None and row["first"] != row["page_id"]
                    archive.add(page_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["first"], revisit, date))
                    if archive.bytes >= ARCHIVE_BYTES:
                        archive.close()
                        done.append(archive)
                        archive, number = None, number + 1
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays(
            [pa.array([os.path.basename(a.path) for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.bytes for a in done], pa.int64())],
            names=["archive", "records", "bytes"],
        )

    return cut_lineage(records.mapInArrow(write, "archive string, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """The page records of archives named in column `archive`: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the payload read and compared with its header; a difference raises. A
    revisit holds no payload: its size and digest are those its headers state. with_payload adds the payload (null
    for revisits). One archive is one task, read as a stream of records.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for name in (n for b in batches for n in b.column("archive").to_pylist()):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for headers, block in map(parse, frames(stream)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    if kind == "response" and (size != len(payload) or stated != base32_sha1(payload)):
                        raise ValueError(f"the payload of {headers['warc-record-id']} is not the one its headers state")
                    refers = _id(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                    row = (_id(headers["warc-record-id"]), headers.get("warc-target-uri"), size, stated, kind, refers)
                    rows.append(row + ((payload if kind == "response" else None),) * with_payload)
                    held += len(payload) * with_payload
                    if len(rows) >= 4096 or held >= 16 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    listed = archives.select("archive").repartition(max(1, archives.count()), "archive")
    shape = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    found = listed.mapInArrow(read, shape)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


