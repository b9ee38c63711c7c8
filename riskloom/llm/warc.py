"""Dictionary-compressed WARC archives.

Every page is a WARC 1.1 record.  Pages with equal payloads are archived once:
the one with the largest id is a ``response`` record, the others are
``revisit`` records that refer to it.  Each Spark partition becomes one
``.warc.zst`` archive: a Zstandard dictionary is trained on the first
``sample_bytes`` of the partition's records and stands at the head in a
skippable frame (magic 0x184D2A5D), and every record is a Zstandard frame of
its own, compressed with it.

The archives are written by Spark's own text writer, one frame a row, so the
output commit protocol guards them against lost executors and any file system
Spark can write to will do.  The writer's row separator is an empty skippable
frame, which every Zstandard reader passes over.

Defined cases: a null payload is empty; rows that repeat an id and payload are
each a response; a null id counts as smaller than any other and is archived
without its header; a partition whose records are too few to train on has no
dictionary frame; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import column

DICTIONARY_FRAME = 0x184D2A5D
#: an empty skippable frame, as text: ends every row of the text writer
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def typed_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, sha1, head): ``head`` is the id of the response for
    a revisit, else null.  Only digests are grouped; payloads join the few
    that repeat."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("sha1", F.sha1("payload"))
    repeated = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
                .agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 and head is not null").select("sha1", "head"))
    return rows.join(repeated, "sha1", "left").select(
        "id", "url", "payload", "sha1",
        F.when(F.coalesce(F.col("id") != F.col("head"), F.col("head").isNotNull()),
               F.col("head")).alias("head"))


def _urn(page) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>"


def record(page, url, payload: bytes, sha1: str, head, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, not the payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    block = http + payload if head is None else http
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}",
             f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}",
             "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if head is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(head)}",
                  f"X-Refers-To-Page-ID: {head}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int):
    """A dictionary from the records, or None if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def _archive(date: str, sample_bytes: int, dict_bytes: int, level: int):
    """Arrow kernel: the frames of one partition's archive, in order."""
    def frames(rows):
        held, size = [], 0
        dictionary = compressor = None
        for rec in rows:
            if compressor is None:
                held.append(rec)
                size += len(rec)
                if size < sample_bytes:
                    continue
                dictionary = train(held, dict_bytes)
                compressor, head = _open(dictionary, level)
                yield from head
                yield from map(compressor.compress, held)
                held = []
            else:
                yield compressor.compress(rec)
        if held:
            compressor, head = _open(train(held, dict_bytes), level)
            yield from head
            yield from map(compressor.compress, held)

    def records(batches):
        for batch in batches:
            cols = [column(batch, i) for i in range(5)]
            for i in range(batch.num_rows):
                page, url, payload, sha1, head = (c[i].as_py() for c in cols)
                yield record(page, url, payload, sha1, head, date)

    def run(batches):
        out, size = [], 0
        for f in frames(records(batches)):
            out.append(f)
            size += len(f)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
    return run


def _open(dictionary, level: int):
    params = {"level": level, "write_content_size": True, "write_checksum": True}
    if dictionary is None:
        return zstandard.ZstdCompressor(**params), []
    data = dictionary.as_bytes()
    return (zstandard.ZstdCompressor(dict_data=dictionary, **params),
            [struct.pack("<II", DICTIONARY_FRAME, len(data)) + data])


def write_archives(typed: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z",
                   sample_bytes: int = 2 << 20, dict_bytes: int = 64 << 10,
                   level: int = 3) -> None:
    """Write the records as ``.warc.zst`` archives below ``path``."""
    (typed.select("id", "url", "payload", "sha1", "head")
     .mapInArrow(_archive(date, sample_bytes, dict_bytes, level), "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0)
     .option("compression", "none").text(path))
    jvm, conf = typed.sparkSession._jvm, typed.sparkSession._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    for st in fs.listStatus(folder):
        name = st.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(
                folder, name.removesuffix(".txt") + ".warc.zst"))


def archive_records(data):
    """The records of one archive, one after another."""
    view, pos, dctx = memoryview(data), 0, zstandard.ZstdDecompressor()
    while pos + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, pos)
        if magic >> 4 == DICTIONARY_FRAME >> 4:
            if magic == DICTIONARY_FRAME:
                raw = bytes(view[pos + 8:pos + 8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            pos += 8 + size
            continue
        frame, out = dctx.decompressobj(), []
        while not frame.eof:
            chunk = view[pos:pos + (1 << 15)]
            if not len(chunk):
                raise ValueError("archive ends within a frame")
            out.append(frame.decompress(chunk))
            pos += len(chunk)
        pos -= len(frame.unused_data)
        yield b"".join(out)


def parsed(rec: bytes):
    """(headers, HTTP headers, payload or None for a revisit)."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    if len(block) < int(headers["Content-Length"]):
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return headers, fields, payload if headers["WARC-Type"] == "response" else None


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long")


def _read(with_payload: bool):
    def rows(data):
        for rec in archive_records(data):
            h, http, payload = parsed(rec)
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if payload is not None and base64.b32encode(
                    hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
            refers = h.get("X-Refers-To-Page-ID")
            page = h.get("X-Page-ID")
            yield (None if page is None else int(page), h.get("WARC-Target-URI"),
                   int(http["Content-Length"]), digest, h["WARC-Type"],
                   None if refers is None else int(refers), payload)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.binary()][:6 + with_payload]

    def batch_of(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*held)), types)],
            [str(i) for i in range(len(types))])

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                held, size = [], 0
                for row in rows(cell.as_buffer()):
                    held.append(row)
                    size += 200 + (len(row[6] or b"") if with_payload else 0)
                    if size >= 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)
    return run


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``; a response's payload is
    checked against its digest."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst")
             .load(path).select("content"))
    return files.mapInArrow(_read(with_payload),
                            _READ + (", payload binary" if with_payload else ""))
