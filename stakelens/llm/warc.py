"""WARC archives compressed with Zstandard: one frame per record, a dictionary ahead.

An archive starts with a skippable frame that holds its dictionary (itself a Zstandard
frame); every record after it is one frame that uses the dictionary. Other skippable frames
are passed over. A record whose payload of at least `MIN_REVISIT` bytes is held by a record
with a smaller page id is written as a revisit of that record, without the payload.

Each task builds its archives on its own, each of at most `ARCHIVE_BYTES` (or one record),
with a dictionary trained on the first records of the archive. Spark writes them through
its text sink, one row per file, so that a repeated task leaves no half-written file; the
line end of that sink is an empty skippable frame.

Defined results: a null page is an empty payload. A null url is written as an empty target
and read back as null. A row with a null page_id is always a response and never referred to.
Repeated rows of the smallest id are all responses. An empty table gives no records. Columns
other than page_id, url and html are not read. A record that does not hold what its headers
say is read with the reason in `error`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
TRAINING_BYTES = 2 << 20
LEVEL = 3

# Fixed values of the Zstandard and WARC formats.
DICTIONARY_MAGIC = 0x184D2A5D .to_bytes(4, "little")
FRAME_MAGIC = 0xFD2FB528 .to_bytes(4, "little")
SKIPPABLE_MAGICS = frozenset((0x184D2A50 + k).to_bytes(4, "little") for k in range(16))
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string, error string"
)


# -- one record ---------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record if `refers_to` is a page id."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += f"Content-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = head.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError("a record id is not of a page")
    return int(name[10:-1]) if name[10:-1] else None


def _line(url: str) -> str:
    """A url on one line: percent signs, line ends and edges of white space are escaped."""
    out = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return out.replace(" ", "%20").replace("\t", "%09")


def _url(line: str) -> str | None:
    out = line.replace("%09", "\t").replace("%20", " ").replace("%0A", "\n")
    return out.replace("%0D", "\r").replace("%25", "%") or None


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        out[key.strip().lower()] = value.strip(" \t")
    return out


def parsed(raw: bytes) -> dict:
    """The fields of a record. Raises ValueError if headers, lengths or digest do not hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError("not a WARC 1.1 record")
    fields = _fields(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise ValueError(f"no {min(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is not a number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its content-length")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("the block is not an HTTP response")
    status, _, lines = http.partition(b"\r\n")
    size = _fields(lines).get("content-length", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind, refers_to = fields["warc-type"], None
    if kind == "revisit":
        if fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields:
            raise ValueError("a revisit does not say of what")
        refers_to = _page(fields["warc-refers-to"])
        if payload:
            raise ValueError("a revisit has a payload")
    elif kind == "response":
        if size != str(len(payload)):
            raise ValueError("the payload is not as long as its content-length")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload does not match its digest")
    else:
        raise ValueError(f"an unknown record type: {kind}")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": _url(fields.get("warc-target-uri", "")),
        "record_type": kind,
        "refers_to": refers_to,
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(size) if size.isdigit() else None,
        "payload_digest": digest,
        "error": None,
    }


# -- one archive --------------------------------------------------------------------------


def archive(records: list[bytes]) -> bytes:
    """The records as frames after the frame of their dictionary."""
    words = _dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    held = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
    lead = DICTIONARY_MAGIC + len(held).to_bytes(4, "little") + held
    return b"".join([lead, *map(packer.compress, records)])


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    samples, size = [], 0
    for r in records:
        samples.append(r[: 8 << 10])
        size += len(samples[-1])
        if size >= TRAINING_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:  # too few samples: the first of them serves as it is
        return zstandard.ZstdCompressionDict(
            samples[0][:DICTIONARY_BYTES].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )


def frames(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(magic, frame) in order, without decoding. Raises ValueError at a broken frame."""
    at = 0
    while at < len(data):
        magic, start = bytes(data[at : at + 4]), at
        if magic in SKIPPABLE_MAGICS:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        elif magic == FRAME_MAGIC:
            checksum = data[at + 4] & 4
            at += zstandard.frame_header_size(bytes(data[at : at + 18]))
            last = False
            while not last:
                if at + 3 > len(data):
                    raise ValueError("a frame is cut off")
                block = int.from_bytes(data[at : at + 3], "little")
                last = bool(block & 1)
                at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            at += 4 if checksum else 0
        else:
            raise ValueError("neither a frame nor a skippable frame")
        if at > len(data):
            raise ValueError("a frame is cut off")
        yield magic, data[start:at]


def records(content: bytes) -> Iterator[dict]:
    """The records of an archive; what cannot be read gives a row with `error`."""
    reader, first = zstandard.ZstdDecompressor(), True
    try:
        for magic, frame in frames(memoryview(content)):
            if first and magic == DICTIONARY_MAGIC:
                held = bytes(frame[8:])
                if held[:4] == FRAME_MAGIC:
                    held = reader.decompress(held)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            elif magic == FRAME_MAGIC:
                try:
                    yield parsed(reader.decompress(bytes(frame)))
                except (ValueError, UnicodeDecodeError, zstandard.ZstdError) as error:
                    yield _broken(error)
            first = False
    except (ValueError, zstandard.ZstdError) as error:
        yield _broken(error)


def _broken(error: Exception) -> dict:
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    return dict.fromkeys(names) | {"error": f"{type(error).__name__}: {error}"}


# -- tables -------------------------------------------------------------------------------


def planned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response) for each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    held = rows.filter(F.octet_length("payload") >= min_revisit).filter("page_id IS NOT NULL")
    first = (
        held.groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .filter("first_id < last_id")
        .select("digest", "first_id")
    )
    return rows.join(first, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages under `path`, a folder that all executors can write to."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                made = record(
                    row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]
                )
                if held and size + len(made) > archive_bytes:
                    yield _file(held)
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield _file(held)

    files = planned(pages).mapInArrow(build, "archive binary")
    (
        files.select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_FRAME)
        .option("compression", "none")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _file(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`, with `RECORD_SCHEMA`."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("error", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in records(content.as_py()):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def resolved(found: DataFrame) -> DataFrame:
    """Records without payloads; a revisit takes the length from the response it refers to."""
    rows = found.select(
        "page_id",
        "url",
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("n"),
        "payload_digest",
        "record_type",
        "refers_to",
        "error",
    )
    held = (
        rows.filter("record_type = 'response'")
        .groupBy(F.col("page_id").alias("held_id"), F.col("payload_digest").alias("held_digest"))
        .agg(F.max("n").alias("held_n"))
    )
    same = (F.col("refers_to") == F.col("held_id")) & (F.col("payload_digest") == F.col("held_digest"))
    return rows.join(held, same, "left").select(
        "page_id",
        "url",
        F.coalesce("n", "held_n").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        "error",
    )
