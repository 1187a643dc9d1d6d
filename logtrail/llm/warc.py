"""WARC archives in Zstandard form: one frame for each record, the dictionary in a leading skippable frame.

Tasks write archives of bounded size to the shared folder and report them in a manifest; a lost task's
successor writes files of its own name, and only what the manifest lists is read. The reader loads the
dictionary, decodes frame by frame and validates headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, numbered, scratch, slices, table

DICTIONARY_MAGIC = 0x184D2A5D  # a skippable frame
FRAME_MAGIC = 0xFD2FB528
LEAST_SHARED = 100
#: Bytes of an archive after which a task begins the next one.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is fitted on so many pages, so many characters of each. It bears on size only, never on results.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 32768
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def fit_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of bounded size from a bounded sample; raw content where there is too little to fit one."""
    rows = pages.select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("x")).limit(SAMPLE_PAGES).collect()
    samples = [r.x.encode("utf-8", "replace") for r in rows if r.x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header, with the length of the payload, but not the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + "".join((url or "about:blank").split()))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def number(urn: str) -> int | None:
    inside = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes | None]:
    """page_id, payload_bytes, digest, type, refers_to, url, payload; ValueError where a header or length is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first != b"WARC/1.1":
        raise ValueError(f"no WARC/1.1 record: {first[:40]!r}")
    has = fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in has:
            raise ValueError(f"a record without {name}")
    length = int(has["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the frame holds {len(rest) - 4}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("no HTTP header in the record")
    size, kind = int(fields(http.split(b"\r\n")[1:])["content-length"]), has["warc-type"]
    digest = has["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload's length or digest is not the one stated")
    elif kind != "revisit" or payload or "warc-refers-to" not in has:
        raise ValueError(f"a {kind} record that is neither response nor revisit")
    refers = number(has["warc-refers-to"]) if kind == "revisit" else None
    return number(has["warc-record-id"]), size, digest, kind, refers, has.get("warc-target-uri", ""), payload if kind == "response" else None


class Archive:
    """Writes one archive."""

    def __init__(self, path: str, dictionary: bytes):
        self.path = path
        files, inside = pafs.FileSystem.from_uri(path)
        self.out, self.records, self.bytes = files.open_output_stream(inside), 0, 8 + len(dictionary)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)

    def add(self, raw: bytes) -> None:
        frame = self.zip.compress(raw)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def frames(stream, at_once: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of an archive, one for each record; the dictionary comes first."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    if len(dictionary := stream.read(size)) != size:
        raise ValueError("the dictionary frame is cut short")
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    frame, parts = None, []
    while chunk := stream.read(at_once):
        while chunk:
            frame = frame or unzip.decompressobj()
            parts.append(frame.decompress(chunk))
            chunk = b""
            if frame.eof:
                chunk = frame.unused_data
                yield b"".join(parts)
                frame, parts = None, []
    if frame is not None:
        raise ValueError("the last frame is cut short")


def with_references(spark: SparkSession, pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, digest and refers_to: of equal payloads of at least `least` bytes one stays whole.

    That is the one of the smallest page_id; of rows that share it, the one read first, and the others revisit it. A
    payload of which no row has an id stays whole in every row, since nothing could be referred to. Rows are numbered
    and written once; only numbers and digests are grouped, summed before the shuffle, and the first of each is
    written, so that the join has two shuffles of its own and Spark splits a hot payload. The pages move once, by
    number, so copies of one payload spread over all tasks.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    digest = F.sha2(F.encode(html, "UTF-8"), 256)
    some = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], html.alias("html"), digest.alias("digest"))
    rows = numbered(spark, some, "warc-rows").select("_row", "doc.*")
    keys = rows.filter(F.octet_length("html") >= least).select("_row", "page_id", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    first = keys.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1 AND first.page_id IS NOT NULL").select("digest", "first")
    again = keys.join(materialize(spark, first, "warc-first"), "digest").filter("_row <> first._row")
    return rows.join(again.select("_row", F.col("first.page_id").alias("refers_to")), "_row", "left").drop("_row")


def write(spark: SparkSession, pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page to archives in `folder` (any URI that pyarrow opens); returns the manifest."""
    dictionary = fit_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get(), None, []
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        files, inside = pafs.FileSystem.from_uri(folder)
        files.create_dir(inside, recursive=True)
        for batch in slices(batches):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(f"{name}-{len(done):04d}.warc.zst", dictionary)
                archive.add(record(page_id, url, html.encode("utf-8"), digest, refers_to, date))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        done += [archive.close()] if archive else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return materialize(spark, with_references(spark, pages).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives in `manifest`: path and records; ValueError if one is broken or records are missing."""
    schema = READ_SCHEMA + (", payload binary" if payload else "")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 6 + payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, inside = pafs.FileSystem.from_uri(path)
                rows, seen = [], 0
                with files.open_input_stream(inside) as stream:
                    for raw in frames(stream):
                        rows.append(parse(raw)[: 6 + payload])
                        seen += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} holds {seen} records, the manifest states {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("path", "records").repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page, as read back from the archives. Empty tables give no archive and no row."""
    manifest = write(spark, table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
