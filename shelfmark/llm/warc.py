"""Zstandard-compressed WARC archives: written from pages, and read back record by record.

An archive is a sequence of Zstandard frames. The first is a skippable frame with the dictionary; then each record
is one frame of its own. After every frame stands an empty skippable frame, which any decoder passes over: it
is the line separator with which Spark's text writer ends a row, so archives are written by Spark itself,
streamed, into any store, with its commit protocol. They are read whole with the binary-file reader, so the writer
keeps archives small.

Payloads that occur more than once are stored once, in the record of the largest page id; the other
records are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, stored

# Frame magics of the format.
DICTIONARY_MAGIC = bytes.fromhex("5D2A4D18")
FRAME_MAGIC = bytes.fromhex("28B52FFD")
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload_digest: str, payload_bytes: int, refers_to: int | None, body: bytes) -> bytes:
    """One WARC record; a header value is kept on one line."""
    clean = " ".join((url or "").split())
    head = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {payload_bytes}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary from sample payloads; where there are too few to train one, their beginnings as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def sample_payloads(pages: DataFrame, payload: str, rows: int = 200, most: int = 1 << 14) -> list[bytes]:
    """At most ``rows`` distinct payloads, each cut to ``most`` characters, to train the dictionary on: a bounded sample.

    They are chosen by hash first, so that only hashes of many tasks meet, and ``rows`` payloads are fetched.
    """
    hashed = pages.select(F.xxhash64(payload).alias("h"), F.col(payload).alias("p")).filter(F.length("p") > 0)
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(rows).collect()]
    found = hashed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.first(F.substring("p", 1, most)).alias("p"))
    return [r["p"].encode() for r in found.orderBy("h").collect()]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
    return zstandard.ZstdCompressor(level=6, dict_data=data, write_content_size=True, write_checksum=True)


def write_archives(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record for every row of ``pages`` below ``root``.

    A null payload is empty, a null url an empty one. Of rows with equal payloads, those with the largest id are responses
    (all of them, where that id is repeated); a row without an id refers to the largest id, and is a response if no
    row with its payload has one. Payloads are compressed where they are read; only compressed records are shuffled.
    """
    spark = pages.sparkSession
    dictionary = train_dictionary(sample_payloads(pages, payload))
    shared = spark.sparkContext.broadcast(dictionary)

    def responses(batch: pa.RecordBatch):
        compress, out = _compressor(shared.value), {c: [] for c in ("id", "uri", "digest", "bytes", "frame")}
        held = 0
        for page, uri, value in zip(*(batch.column(i) for i in range(3))):
            body = (value.as_py() or "").encode()
            own, at, link = digest(body), page.as_py(), uri.as_py()
            frame = compress.compress(record("response", at, link, own, len(body), None, body))
            for c, v in zip(out, (at, link, own, len(body), frame)):
                out[c].append(v)
            held += len(frame)
            if held > 1 << 22:
                yield columns(out)
                out, held = {c: [] for c in out}, 0
        if out["id"]:
            yield columns(out)

    def columns(out):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return {c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)}

    made = stored(
        map_batches(pages.select(F.col(page_id).cast("long"), url, payload), responses, "id long, uri string, digest string, bytes long, frame binary"),
        "records",
    )
    largest = stored(made.groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("same")), "largest")
    several = stored(largest.filter("same > 1").drop("same"), "several")
    told = made.join(several, "digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    told = told.select("id", "uri", "digest", "bytes", F.when(revisit, F.col("largest")).alias("refers_to"), F.when(~revisit, F.col("frame")).alias("frame"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, first = _compressor(shared.value), True
        for batch in batches:
            out = []
            if first and batch.num_rows:
                out.append(DICTIONARY_MAGIC + len(shared.value).to_bytes(4, "little") + shared.value)
                first = False
            for page, uri, own, size, refers, frame in zip(*(batch.column(i) for i in range(6))):
                out.append(frame.as_py() if frame.is_valid else compress.compress(
                    record("revisit", page.as_py(), uri.as_py(), own.as_py(), size.as_py(), refers.as_py(), b"")))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = told.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", EMPTY_FRAME).text(root)


def frame_length(data: memoryview) -> int:
    """Bytes of the Zstandard frame at the beginning of ``data``, from its header and block headers."""
    if len(data) < 6:
        raise ValueError("a frame is cut off")
    flags = data[4]
    single = flags >> 5 & 1
    at = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def read_frames(data: memoryview) -> Iterator[bytes]:
    """The content of each record's frame of an archive."""
    at, decompress = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = bytes(data[at:at + 4])
        if magic == FRAME_MAGIC:
            n = frame_length(data[at:])
            yield decompress.decompressobj().decompress(data[at:at + n])
            at += n
        elif magic[1:] == DICTIONARY_MAGIC[1:] and magic[:1] >= b"\x50" and magic[0] <= 0x5F:
            n = int.from_bytes(data[at + 4:at + 8], "little")
            if at + 8 + n > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                held = bytes(data[8:8 + n])
                if held[:4] == FRAME_MAGIC:
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                if len(held) >= 8:
                    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + n
        else:
            raise ValueError(f"neither a Zstandard nor a skippable frame at byte {at}")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of a record; ``ValueError`` if it is not well formed.

    Checked: version line, header lines, required fields, length of the body, the two line ends after it, and the digest of a
    response's payload.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        headers[name.strip().lower().decode()] = value.strip().decode()
    lacking = {"warc-type", "warc-record-id", "content-length"} - set(headers)
    if lacking:
        raise ValueError(f"without {', '.join(sorted(lacking))}")
    n = int(headers["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the body has another length than its header says")
    body = rest[:n]
    told = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and told.startswith("sha1:") and told[5:] != digest(body):
        raise ValueError("the payload has another digest than its header says")
    return headers, body


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, error)``: one row per record.

    ``payload`` is null for a revisit. A record that is not well formed has only ``error``; so has an archive that breaks off.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def row(data: bytes) -> tuple:
        try:
            h, body = parse_record(data)
            kind = h["warc-type"]
            whole = int(h.get("x-payload-length", len(body)))
            if kind == "response" and whole != len(body):
                raise ValueError("the payload has another length than its header says")
            return (_page(h["warc-record-id"]), h.get("warc-target-uri"), kind, whole, h.get("warc-payload-digest", "").removeprefix("sha1:"),
                    _page(h.get("warc-refers-to")), body if kind == "response" else None, None)
        except (ValueError, UnicodeDecodeError) as e:
            return (*[None] * 7, str(e))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                try:
                    for data in read_frames(memoryview(value.as_buffer())):
                        rows.append(row(data))
                        held += len(data)
                        if held > 1 << 22:
                            yield batch_of(rows)
                            rows, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append((*[None] * 7, str(e)))
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def record_digests(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of records as ``read_archives`` gives them; the
    digest and length of a response are taken from its payload. A record with an error, or an archive that breaks off, fails the job."""
    sound = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("damaged archive: "), "error")).cast("bigint"))
    return records.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
