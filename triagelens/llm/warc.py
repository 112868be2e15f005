"""Zstandard WARC archives with a dictionary of their own.

An archive is one file: first a skippable frame (magic 0x184D2A5D) that holds a dictionary
built from the archive's first records, then one Zstandard frame a record. Tasks give frames
as rows to Spark's text writer with the line separator set to an empty skippable frame, which
every Zstandard reader passes over; so archives are written to any store by Spark's own commit
protocol, and a lost task leaves no half file. Files are read back with the binaryFile source,
which holds one archive (one input split of pages) in memory at a time.

Payloads of 1000 bytes or more that are equal are stored once, with the largest page_id; the
others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import read
from triagelens.session import work_path

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: magic 0x184D2A50, length 0.
GAP = struct.pack("<II", 0x184D2A50, 0)
DICTIONARY_BYTES = 32 << 10
#: Bytes of records that a dictionary is built from.
SAMPLE_BYTES = 2 << 20
LEVEL = 3
LEAST_REVISIT = 1000
SALTS = 16


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the first records themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """WARC record of one page; ``refers_to`` makes it a revisit without payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        *([] if url is None else [f"WARC-Target-URI: {urllib.parse.quote(url, safe=SAFE)}"]), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


SAFE = "".join(chr(c) for c in range(33, 127))
PAGE = re.compile(r"<urn:page:(-?\d*)>")


def parse(raw: bytes) -> dict:
    """Headers of a record, with ``payload`` (None for a revisit) and ``length`` of the full payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return fields | {"payload": payload if fields["WARC-Type"] == "response" else None, "length": length}


def frames(archive: bytes):
    """The records of an archive in order."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(archive):
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        one = reader.decompressobj()
        raw = one.decompress(memoryview(archive)[at:])
        at = len(archive) - len(one.unused_data)
        yield raw


def with_referrals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to) of ``pages``; only ids and digests are compared, hot digests in parts."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    named = pages.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = named.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "sha")
    groups = large.groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null")
    parts = groups.select("sha", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    late = large.withColumn("part", part).join(parts, ["sha", "part"]).where("not page_id <=> original")
    late = late.select(F.col("page_id").alias("late_id"), F.col("sha").alias("late_sha"), "original").distinct()
    joined = named.join(late, F.col("page_id").eqNullSafe(F.col("late_id")) & (F.col("sha") == F.col("late_sha")), "left")
    return joined.select("page_id", "url", "html", F.col("original").alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``, one for each task."""

    def run(batches):
        packer = None
        held: list[bytes] = []
        size = 0

        def flush():
            data = build_dictionary(held)
            made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
            return made, [dictionary_frame(data), *map(made.compress, held)]

        for batch in batches:
            out = []
            for page_id, url, html, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                raw = record(page_id, url, html.encode(), refers_to)
                if packer is None:
                    held.append(raw)
                    size += len(raw)
                    if size >= SAMPLE_BYTES:
                        packer, first = flush()
                        out += first
                else:
                    out.append(packer.compress(raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        if packer is None and held:
            yield pa.RecordBatch.from_arrays([pa.array(flush()[1], pa.binary())], names=["frame"])

    rows = with_referrals(pages).mapInArrow(run, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP.decode("latin-1")).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response whose payload doesn't have its digest fails the job.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(text: str | None) -> int | None:
        found = PAGE.search(text or "")
        return int(found[1]) if found and found[1] else None

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for raw in frames(content.as_py()):
                    x = parse(raw)
                    digest = base64.b32decode(x["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if x["payload"] is not None and hashlib.sha1(x["payload"]).hexdigest() != digest:
                        raise ValueError(f"broken payload of {x['WARC-Record-ID']}")
                    rows.append((number(x["WARC-Record-ID"]), x.get("WARC-Target-URI"), x["length"], digest, x["WARC-Type"], number(x.get("WARC-Refers-To")), x["payload"]))
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    A null html is an empty payload, a null url has no target; a null page_id is larger than
    none, so such a page is a revisit if an equal one has an id. Equal pages with the same,
    largest page_id are all responses. Other columns are ignored.
    """
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


def op6_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    return archive(read(spark, sf_dir, "pages")).drop("url", "payload")
