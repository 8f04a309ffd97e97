"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are built in tasks and written by Spark as real files, so any store that Spark reaches will do. Spark's text
writer puts a separator behind each row; here that is an empty skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.llm.common import slices

# fixed values: magic numbers of the Zstandard format
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLE = 200
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page: int | None, uri: str | None, payload: bytes, own: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record; a revisit has an empty block and names the record that holds the payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {'' if uri is None else ' '.join(uri.split())}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


class BadArchive(ValueError):
    """An archive breaks the format; the message says where."""


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated: version line, header lines, block length and closing line ends."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or not version.startswith(b"WARC/1."):
        raise BadArchive("no WARC header")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"header line without a name: {name[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for wanted in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if wanted not in headers:
            raise BadArchive(f"no {wanted}")
    if not headers["content-length"].isdigit():
        raise BadArchive("content-length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"block of {len(rest) - 4} bytes where {n} are announced")
    block = rest[:n]
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", "") not in ("", f"sha1:{digest(block)}"):
        raise BadArchive("payload digest differs")
    return headers, block


def build_archive(records: list[bytes], level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES, sample: int = DICTIONARY_SAMPLE) -> bytes:
    """One archive: the dictionary in a skippable frame, then one frame per record.

    The dictionary is trained on at most ``sample`` records spread over the archive; too few of them give an archive without one.
    """
    import zstandard

    step = max(1, len(records) // sample)
    some = [r[:dictionary_bytes] for r in records[::step][:sample]]
    lead, trained = b"", None
    if len(some) >= 16:
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, some)
        except zstandard.ZstdError:
            trained = None  # the records are too short or too alike to train on
    if trained is not None:
        content = trained.as_bytes()
        lead = struct.pack("<II", DICTIONARY_FRAME, len(content)) + content
    one = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return lead + b"".join(map(one.compress, records))


def read_archive(content: bytes) -> Iterator[bytes]:
    """Uncompressed records of an archive; the dictionary may itself be compressed."""
    import zstandard

    at, trained = 0, None
    view = memoryview(content)
    plain = None
    while at < len(content):
        if at + 4 > len(content):
            raise BadArchive("cut off inside a frame's magic number")
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at + 8 + size > len(content):
                raise BadArchive("cut off inside a skippable frame")
            if magic == DICTIONARY_FRAME:
                if at:
                    raise BadArchive("the dictionary frame does not come first")
                data = bytes(view[8 : 8 + size])
                if data[:4] == FRAME_MAGIC:
                    data = zstandard.ZstdDecompressor().decompress(data)
                trained = zstandard.ZstdCompressionDict(data)
            at += 8 + size
            continue
        plain = plain or zstandard.ZstdDecompressor(dict_data=trained)
        try:
            whole = plain.decompressobj()
            record = whole.decompress(view[at:])
        except zstandard.ZstdError as error:
            raise BadArchive(f"frame at byte {at}: {error}") from error
        if not whole.eof:
            raise BadArchive("cut off inside a frame")
        yield record
        at = len(content) - len(whole.unused_data)


def with_originals(pages: DataFrame, min_bytes: int, id_col: str, payload_col: str, uri_col: str) -> DataFrame:
    """Columns page, uri, payload, sha1 and refers_to: for each payload of ``min_bytes`` or more the smallest page is the original.

    Rows of the original's own page are responses too if the page is listed twice. A null page cannot be referred to: its row is a response
    unless another page has the payload. The digests are found without moving payloads; hot payloads are pre-aggregated by digest.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{uri_col}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    # only digests with more than one row can have revisits
    first = (
        rows.filter(large).groupBy("sha1").agg(F.min("page").alias("original"), F.count("*").alias("copies"))
        .filter("copies > 1").select("sha1", "original")
    )
    joined = rows.join(first, "sha1", "left")
    revisit = large & F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page"))
    return joined.select("page", "uri", "payload", "sha1", F.when(revisit, F.col("original")).alias("refers_to"))


def archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Columns archive (a fresh name) and content, from rows of :func:`with_originals`. An archive closes at ``archive_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"pages-{uuid.uuid4().hex}"]), pa.array([build_archive(records)], pa.binary())], names=["archive", "content"]
            )

        for batch in (part for whole in batches for part in slices(whole)):
            for page, uri, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page", "uri", "payload", "refers_to")), strict=True):
                record = build_record(page, uri, payload, digest(payload), refers_to)
                if records and size + len(record) > archive_bytes:
                    yield close()
                    records, size = [], 0
                records.append(record)
                size += len(record)
        if records:
            yield close()

    return rows.select("page", "uri", "payload", "refers_to").mapInArrow(run, "archive string, content binary")


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write every row of ``pages`` as a record below ``path``, one folder with one file per archive.

    A null payload counts as empty, a null page or url leaves its header empty. Repeated rows are records of their own. An empty table writes
    no archive. Other columns are not read.
    """
    built = archives(with_originals(pages, min_bytes, id_col, payload_col, uri_col), archive_bytes)
    built.select("archive", F.col("content").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """One row per record below ``path``: page, uri, record type, digest, payload length and the page it refers to.

    Every frame is decoded on its own, and headers, lengths and digests are validated; a broken archive fails the read. A revisit's
    payload facts come from its headers. ``with_block`` adds the block as bytes.
    """
    fields = "page long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", block binary" * with_block
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * with_block]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in read_archive(content.as_py()):
                    headers, block = parse_record(raw)
                    rows.append(_facts(headers, block, with_block))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, fields)


def _facts(headers: dict[str, str], block: bytes, with_block: bool) -> list:
    kind = headers["warc-type"]
    length = int(headers.get("x-payload-length", len(block)))
    if kind == "response" and length != len(block):
        raise BadArchive("payload length differs")
    row = [
        _page(headers["warc-record-id"]), headers.get("warc-target-uri") or None, kind,
        headers.get("warc-payload-digest", "").removeprefix("sha1:"), length, _page(headers.get("warc-refers-to", "")),
    ]
    return [*row, block] if with_block else row


def _page(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None
