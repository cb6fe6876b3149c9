"""WARC archives compressed with Zstandard: a dictionary in the leading
skippable frame, then one frame for each record.

An archive is one binary value, so a table of archives can live in any store
that Spark reads; ``spark.read.format("binaryFile")`` gives the same shape for
files.  Writing fills archives as rows arrive, up to a size, so no archive
grows with the input.  Reading checks the dictionary frame, each frame, each
record's version line, headers and lengths, and the payload digest, and stops
with an error that names the archive if one is wrong.

Null html counts as empty.  Of pages with equal payloads of at least
``least`` bytes, that with the smallest id is the response and others are
revisits; rows that repeat the smallest id stay responses.  A null id is larger
than all others.  A page of any length is one record, and one that is larger than
an archive should be is an archive of its own.  A payload that a third of the
pages have is met by broadcast where they lie.  Other columns are ignored; an
empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import HOT_SHARE, stored

#: Magic numbers of the dictionary's skippable frame and of a dictionary (fixed values of the format).
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437
#: Bytes of records in an archive before compression, of a dictionary, and of the records that train it.
ARCHIVE, DICT, TRAIN = 4 << 20, 16 << 10, 1 << 20

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str, payload: bytes, length: int, sha: str, refers: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit holds only the response's HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The archive's bytes.  The dictionary in the leading frame is trained on the archive's own records; where they are
    too few or too much alike to train one, it is raw content: the first record's head."""
    sample, size = [], 0
    for r in records:
        if size >= TRAIN:
            break
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
    try:
        learned = zstandard.train_dictionary(DICT, sample, level=3, k=512, d=8)
    except zstandard.ZstdError:
        learned = zstandard.ZstdCompressionDict(sample[0][:DICT], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=learned, write_checksum=True, write_content_size=True)
    raw = learned.as_bytes()
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(packer.compress, records))


def records(data: bytes):
    """The records of an archive, decoded one frame at a time; ValueError if it is damaged."""
    at, learned = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = data[8 : 8 + size], 8 + size
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut off")
        if raw[:4] == zstandard.FRAME_HEADER:  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if len(raw) < 8:
            raise ValueError("the leading frame holds no dictionary")
        full = struct.unpack_from("<I", raw)[0] == DICTIONARY
        learned = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)
    reader = zstandard.ZstdDecompressor(dict_data=learned)
    while at < len(data):
        try:
            frame = reader.decompressobj()
            text = frame.decompress(memoryview(data)[at:])
        except zstandard.ZstdError as e:
            raise ValueError(f"byte {at}: {e}") from e
        if not frame.eof:
            raise ValueError(f"byte {at}: the frame is cut off")
        at = len(data) - len(frame.unused_data)
        yield text


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated."""
    head, gap, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length is not the block's length")
    return fields, rest[:-4]


def _page(value: str) -> int | None:
    said = value.removeprefix("<urn:page:").removesuffix(">")
    return int(said) if said else None


def page_record(text: bytes) -> tuple:
    """The columns of RECORD."""
    fields, block = parse(text)
    http, gap, payload = block.partition(b"\r\n\r\n")
    kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    if not gap or kind not in ("response", "revisit") or length < 0:
        raise ValueError("no HTTP response inside")
    if kind == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError("the payload's length or digest is wrong")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page(fields["warc-record-id"]), length, sha, kind, refers, fields.get("warc-target-uri", ""), payload if kind == "response" else None


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """id, url, html (null for revisits), bytes, sha, first: the id of the response
    with this payload.  A payload is known by its digest, and hot payloads are few,
    see HOT_SHARE.  Html is not shuffled while the digests of repeated payloads can
    be broadcast; beyond that, the rows of payloads that are not hot are, once."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("sha"))
    alike = stored(base.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("w")).where("w > 1"), "payloads")
    total = pages.count()
    hot = alike.where(F.col("w") * HOT_SHARE >= F.lit(total)).select("sha", "first")
    cold = alike.where(F.col("w") * HOT_SHARE < F.lit(total)).select("sha", "first")
    first = base.join(F.broadcast(hot), "sha")
    rest = base.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(cold, "sha", "left")
    both = first.unionByName(rest)
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return both.select("id", "url", F.when(~again, F.col("html")).alias("html"), "bytes", "sha", F.when(again, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, least: int = 0, size: int = ARCHIVE) -> DataFrame:
    """One row for each archive: ``content`` binary."""

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for id_, url, html, length, sha, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                sha32 = base64.b32encode(bytes.fromhex(sha)).decode()
                safe = " ".join((url or "").split())
                held.append(record("response" if html is not None else "revisit", id_, safe, (html or "").encode(), length, sha32, first))
                total += len(held[-1])
                if total >= size:
                    yield pa.RecordBatch.from_pydict({"content": [archive(held)]})
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": [archive(held)]})

    return typed(pages, least).select("id", "url", "html", "bytes", "sha", "first").mapInArrow(run, "content binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives in column ``content``, with the columns of RECORD; without ``payloads`` these stay null."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for i, text in enumerate(records(data.as_py())):
                    try:
                        row = page_record(text)
                    except ValueError as e:
                        raise ValueError(f"record {i} of an archive of {len(data.as_py())} bytes: {e}") from e
                    rows.append(row if payloads else (*row[:-1], None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                names = [x.split()[0] for x in RECORD.split(", ")]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return archives.select("content").mapInArrow(run, RECORD)


#: Base32 of SHA-1 from its 40 hexadecimal digits: five digits make four letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0))
ORACLE = f"""SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS NOT DISTINCT FROM f THEN NULL ELSE f END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)"""
