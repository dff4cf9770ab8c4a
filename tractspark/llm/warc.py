"""WARC archives compressed by Zstandard: a writer and a validating reader.

An archive is a leading skippable frame that holds the dictionary, then one frame per record. Each task writes archives of a bounded size
into the folder given, under names no other attempt uses, and returns a manifest; only archives that the manifest lists are read, so
archives of lost or repeated attempts don't count. The reader gets the files through Spark's binaryFile source, loads the dictionary,
finds each frame from its block headers, decodes it alone, and checks the version line, the headers, both lengths, the end of the record
and the payload's digest.

Of records with equal payloads (SHA-1 and length) of at least `revisit_from` bytes the one with the largest page_id is the response and
the others are revisits of it; smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url leaves the target out; rows with a null page_id are never the response that
others refer to (if all of a group are null, all are responses); rows that repeat the largest page_id are responses alike; an empty table
gives an archive-less manifest and no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_rows, materialise, new_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of an archive, about, and of the dictionary and the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 32 << 20, 16 << 10, 1 << 20

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive or a record breaks the format."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its header and block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise WarcError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise WarcError("a frame is cut off")
    return at


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record whose HTTP header tells the payload's length."""
    urn = lambda x: f"<urn:page:{x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id) if page_id is not None else f'<{uuid.uuid5(uuid.NAMESPACE_URL, digest).urn}>'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {quote(url or '', safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}"] * (url is not None)
    head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] * (refers_to is not None)
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(part: bytes) -> dict[str, str]:
    out = {}
    for line in part.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a header has no colon: {line[:60]}")
        out[name.lower()] = value.strip()
    return out


def decode_record(record: bytes) -> tuple:
    """The fields of RECORD; raises WarcError if headers, lengths or digest don't hold."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not gap:
        raise WarcError("no WARC header")
    names = _headers(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in names:
            raise WarcError(f"a record has no {name}")
    n = int(names["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("a record's Content-Length doesn't match its block")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/") or not gap:
        raise WarcError("a block has no HTTP header")
    size, kind, digest = int(_headers(http)["content-length"]), names["warc-type"], names["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise WarcError("a payload doesn't match its length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit") != ("warc-refers-to" in names) or kind == "revisit" and payload:
        raise WarcError(f"a {kind} record isn't as it should be")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x.startswith("<urn:page:") else None
    refers = number(names["warc-refers-to"]) if kind == "revisit" else None
    return number(names["warc-record-id"]), names.get("warc-target-uri"), size, digest, kind, refers, payload if kind == "response" else None


def read_archive(data: bytes) -> Iterator[tuple]:
    """Records of an archive: the dictionary of a leading skippable frame, then a frame for each record."""
    view, at, dictionary = memoryview(data).cast("B"), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        if at > len(view):
            raise WarcError("the dictionary frame is cut off")
        raw = bytes(view[8:at])
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != struct.pack("<I", DICTIONARY_MAGIC):
            raise WarcError("the dictionary frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        end = frame_end(view, at)
        frame = reader.decompressobj()
        record = frame.decompress(view[at:end])
        if not frame.eof:
            raise WarcError("a frame is cut off")
        yield decode_record(record)
        at = end


class ArchiveWriter:
    """Writes records into an open stream; the first ones train the dictionary."""

    def __init__(self, stream):
        self.stream, self.waiting, self.size, self.codec, self.written = stream, [], 0, None, 0

    def add(self, record: bytes) -> None:
        if self.codec is None:
            self.waiting.append(record)
            self.size += len(record)
            if self.size >= TRAINING_BYTES:
                self.start()
        else:
            self.put(record)

    def put(self, record: bytes) -> None:
        self.written += self.stream.write(self.codec.compress(record))

    def start(self) -> None:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:4096] for x in self.waiting])
        except zstandard.ZstdError:  # too few records to train on: the archive goes without
            dictionary = None
        if dictionary is not None:
            raw = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
            self.written += self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.put(record)
        self.waiting = []

    def close(self) -> None:
        if self.codec is None:
            self.start()
        self.stream.close()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from 20 bits of the hexadecimal digest at a time."""
    digest = F.sha1(payload)
    digit = lambda g, shift: F.substring(F.lit(BASE32), F.shiftright(F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int"), shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(g, shift) for g in range(8) for shift in (15, 10, 5, 0)])


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under folder; returns the manifest: file, records, bytes."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = rows.filter(F.octet_length("html") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    rows = rows.join(first, "sha", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", refers.alias("refers_to"))

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, n, done = None, "", 0, []

        def finish():
            out.close()
            done.append((name, n, out.written))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = ArchiveWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                payload = html.encode()
                out.add(encode_record(page_id, url, payload, payload_digest(payload), refers_to))
                n += 1
                if out.written >= ARCHIVE_BYTES:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    with arrow_rows(pages.sparkSession, 256):
        return materialise(rows.mapInArrow(write, "file string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records (RECORD) of the archives that the manifest lists; fails if an archive is broken or has other than its number of records."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], StructType.fromDDL(RECORD))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = files.join(manifest, "file").select("file", "content", "records")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for file, content, records in zip(*batch.columns):
                n, part = 0, []
                for record in read_archive(content.as_buffer()):
                    part.append(record if keep_payload else (*record[:-1], None))
                    n += 1
                    if len(part) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
                        part = []
                if n != records.as_py():
                    raise WarcError(f"{file} has {n} records; the manifest has {records}")
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    with arrow_rows(spark, 1):
        return materialise(listed.mapInArrow(read, RECORD), "records")


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes the pages as archives, reads the archives back and returns what the records say."""
    folder = new_path(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder, revisit_from), folder, keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
