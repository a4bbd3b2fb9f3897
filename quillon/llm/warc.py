"""Zstandard web archives: one frame per record, a shared dictionary in the leading skippable frame.

An archive file is ``skippable frame 0x184D2A5D (the dictionary)``, then one compressed frame per record. Spark's text
writer puts its line separator after each value; here that is an empty skippable frame (0x184D2A50, length 0), which
every Zstandard reader steps over. So archives are valid files on any store that Spark writes, and appear only once
their task has committed.

Writing groups equal payloads by their SHA-256 (the header's SHA-1 has published collisions), with a map-side combined minimum, so a payload that a third of all pages
share reaches its reducer as one row per map task; only payloads that occur twice are joined back. Reading walks a file
frame by frame, finds each frame's end from its block headers, decodes it alone and checks the record's version, headers,
lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Work, map_batches, read_table

DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: The line separator of the writer: an empty skippable frame.
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
#: Pages that the dictionary is trained on, at most, bytes taken of each, bytes of the dictionary, and compression level.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES, LEVEL = 400, 16_384, 32_768, 3
#: Payloads under so many bytes are never revisits.
MIN_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A damaged archive or record."""


def record_id(page_id: int, serial: int = 0) -> str:
    """A urn that holds the page id's 64 bits; a serial number tells records without a page id apart."""
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-{serial:012x}>"


def page_of(urn: str) -> int:
    m = re.fullmatch(r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f])00-[0-9a-f]{12}>", urn)
    if not m:
        raise ArchiveError(f"record id {urn!r}")
    n = int("".join(m.groups()), 16)
    return n - (1 << 64) if n >> 63 else n


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: int = 0) -> bytes:
    """A whole record; with ``refers_to`` a revisit, whose block has the HTTP headers only."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Record-ID: {record_id(page_id or 0, serial)}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    lines += ["X-Page-Id-Null: true"] * (page_id is None)
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def headers(raw: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in out:
            raise ArchiveError(f"{what} header {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def length_of(head: dict[str, str], what: str) -> int:
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise ArchiveError(f"{what} without a length")
    return int(head["content-length"])


def parse(raw: bytes) -> dict:
    """A record's fields, all of them checked; an ArchiveError where one is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, eol, fields = head.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not gap or not eol:
        raise ArchiveError(f"not a record: {raw[:40]!r}")
    h = headers(fields, "record")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(h):
        raise ArchiveError(f"record without {', '.join(sorted(missing))}")
    n = length_of(h, "record")
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise ArchiveError("a record's length is wrong")
    if "warc-block-digest" in h and h["warc-block-digest"] != "sha1:" + digest(block):
        raise ArchiveError("a block's digest is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, fields = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/1."):
        raise ArchiveError("not an HTTP response")
    size, kind, sha = length_of(headers(fields, "HTTP"), "HTTP response"), h["warc-type"], h["warc-payload-digest"]
    if not re.fullmatch(r"sha1:[A-Z2-7]{32}", sha):
        raise ArchiveError(f"payload digest {sha!r}")
    if kind == "response":
        if size != len(payload) or sha != "sha1:" + digest(payload):
            raise ArchiveError("a payload's length or digest is wrong")
        refers_to = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in h or "warc-profile" not in h:
            raise ArchiveError("a revisit with a payload, or that refers to nothing")
        refers_to, payload = page_of(h["warc-refers-to"]), None
    else:
        raise ArchiveError(f"record type {kind!r}")
    page = None if h.get("x-page-id-null") == "true" else page_of(h["warc-record-id"])
    return {"page_id": page, "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha[5:], "record_type": kind, "refers_to": refers_to, "payload": payload}


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, bytes]:
    """A dictionary, trained on the samples or empty where they don't do, and its leading frame."""
    import zstandard

    try:
        raw = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        raw = b""
    return raw, struct.pack("<II", DICT_MAGIC, len(raw)) + raw


def frames(data: memoryview):
    """(magic, frame) of each frame. A frame's end follows from its header and block headers."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError("a frame is cut off")
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        elif magic == FRAME_MAGIC:
            d = data[at + 4]
            single = d >> 5 & 1
            end, last = at + 5 + (not single) + (0, 1, 2, 4)[d & 3] + (single, 2, 4, 8)[d >> 6], 0
            while not last:
                if end + 3 > len(data):
                    raise ArchiveError("a frame is cut off")
                b = int.from_bytes(data[end : end + 3], "little")
                last = b & 1
                end += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
            end += 4 * (d >> 2 & 1)
        else:
            raise ArchiveError(f"no frame at byte {at}")
        if end > len(data):
            raise ArchiveError("a frame is cut off")
        yield magic, data[at:end]
        at = end


def records(data: memoryview):
    """The checked records of an archive file."""
    import zstandard

    walk, decoder = frames(data), None
    for k, (magic, frame) in enumerate(walk):
        if magic == DICT_MAGIC:
            if k:
                raise ArchiveError("a dictionary that isn't the first frame")
            raw = bytes(frame[8:])
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else None
        elif magic == FRAME_MAGIC:
            decoder = decoder or zstandard.ZstdDecompressor()
            try:
                out = decoder.decompressobj().decompress(frame)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame that can't be decoded: {e}") from e
            yield parse(out)


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes one record per row: a response for the smallest id of each payload, revisits for the others.

    A null payload is empty, a null url is ``about:blank``. Rows with a null id are responses, with record ids of their own.
    Rows that repeat the smallest id and its payload are responses each, and repeat its record id. An empty table gives no records. Other columns are ignored.
    """
    spark = df.sparkSession
    pages = df.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    sample = pages.select(F.substring("payload", 1, SAMPLE_BYTES).alias("p")).limit(SAMPLE_PAGES).collect()
    raw, lead = dictionary_frame([bytes(r.p) for r in sample if len(r.p) >= 8])
    work = Work(spark, "payloads")
    keyed = pages.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    twice = keyed.filter((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice, _ = work.table(twice.select(F.col("sha").alias("t_sha"), "first"), "twice")
    joined = keyed.join(twice, F.col("sha") == F.col("t_sha"), "left")
    rows = joined.select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 28
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
        pending, size = [lead], len(lead)
        for batch in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                serial += page is None
                pending.append(coder.compress(record(page, url, payload, refers_to, 0 if page is not None else serial)))
                size += len(pending[-1])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(pending)], pa.binary())], names=["frames"])
                    pending, size = [], 0
        if pending:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(pending)], pa.binary())], names=["frames"])

    out = map_batches(rows, "warc", run, "frames binary")
    out.select(F.col("frames").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with ``with_payload``,
    the payload (null for revisits). A damaged archive fails the job with an ArchiveError."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=False)], names=names)

        for batch in batches:
            for content in batch.column(0):
                found = []
                for r in records(memoryview(content.as_buffer())):
                    found.append(r)
                    if len(found) == 1000:
                        yield rows(found)
                        found = []
                yield rows(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return map_batches(files, "warc", run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Work(spark, "warc").path("archives")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).drop("url")
