"""WARC archives: writing with segmentation and chunked framing, and reassembly of what was read.

A record's block longer than ``segment_bytes`` is split: the first segment keeps the record's type, the
others are continuation records that name their origin and number, the last also the total length. The
reader groups segments by origin, orders them by number, verifies that numbers are complete and that the
lengths add up to the total, and takes the HTTP body out of its chunked transfer framing. Each record is a
gzip member of its own. What is no whole record is told as such, with the reason, and reading goes on at
the next record; no input makes it fail or loop.

Files are written and read by Spark's own writers and readers, so they may be in any store that Spark
reaches; their commit protocol leaves one copy of each file when tasks are repeated.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import SLICE_BYTES, Scratch, ship

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records of a file, at most: with whole segments, 160 MB before compression.
FILE_RECORDS = 10_000
#: Payloads under so many bytes are always stored themselves.
REVISIT_BYTES = 100
#: Bytes that a gzip member is inflated from at once, and the most that one read of a block asks for.
INFLATED_BYTES, READ_BYTES = 64 << 10, 1 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: The size of a chunk: sixteen hexadecimal digits at most, and nothing else that a number could begin with.
_CHUNK_HEAD = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,16})[ \t]*(?:;[^\r\n]*)?\r\n")
_NUMBER = re.compile(r"[0-9]{1,18}")


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The body in chunked framing (extensions and trailers are passed over); ``None`` if it is broken."""
    out, at = [], 0
    while (m := _CHUNK_HEAD.match(framed, at)) is not None:
        at, n = m.end(), int(m[1], 16)
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(framed[at : at + n])
        at += n + 2
    return None


def payload_of(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + clean.encode() + b"\r\n"


def records_of(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, segment_bytes: int) -> Iterator[bytes]:
    """A record as archive bytes, without the two line ends after each; several if it is segmented."""
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)] or [b""]
    for k, piece in enumerate(pieces, 1):
        own = record_id if k == 1 else f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{record_id}#{k}')}>"
        out = [("WARC-Type", kind if k == 1 else "continuation"), ("WARC-Record-ID", own)]
        out += [f for f in fields if k == 1 or f[0] in ("WARC-Date", "WARC-Target-URI")]
        if len(pieces) > 1:
            out.append(("WARC-Segment-Number", str(k)))
            if k > 1:
                out.append(("WARC-Segment-Origin-ID", record_id))
            if k == len(pieces):
                out.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _header([*out, ("Content-Length", str(len(piece)))]) + piece


def member(record: bytes) -> bytes:
    """A record and the two line ends after it as one gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.compress(b"\r\n\r\n") + packer.flush()


def write(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write ``records`` as WARC files into the folder ``path``, each record a gzip member of its own.

    Columns: record_id, record_type (response or revisit), refers_to, digest (strings), fields (map of
    further header fields) and payload (binary; unused in revisits; null: empty). Null strings and null
    fields are left out.
    """
    if not 0 < segment_bytes < 1 << 23:
        raise ValueError("segments have 1 byte to 8 MB")
    ship(records.sparkSession)
    sent = records.select("record_id", "record_type", "refers_to", "digest", "fields", "payload")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out, size = [], 0
            for r in batch.to_pylist():
                fields = [("Content-Type", "application/http; msgtype=response")]
                fields += [(k, v) for k, v in r["fields"] or () if v is not None]
                if r["digest"] is not None:
                    fields.append(("WARC-Payload-Digest", f"sha256:{r['digest']}"))
                block = _HTTP
                if r["record_type"] == "revisit":
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", r["refers_to"] or "")]
                    block += b"\r\n"
                else:
                    block += b"Transfer-Encoding: chunked\r\n\r\n" + chunked(r["payload"] or b"")
                for one in records_of(r["record_type"], r["record_id"], fields, block, segment_bytes):
                    # a member ends with its length in four bytes, least first: under 16 MB the last is 0, which the
                    # writer of lines puts there
                    out.append(member(one)[:-1])
                    size += len(out[-1])
                if size > SLICE_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    rows = sent.mapInArrow(work, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", file_records).text(path)


class Inflated(io.RawIOBase):
    """The plain bytes of gzip members laid end to end; a member that is broken ends where it breaks, and what
    follows it up to the next member is passed over. Bytes that aren't gzip at all are taken as they are."""

    def __init__(self, content):
        self.content, self.at, self.ready = memoryview(content), 0, b""
        self.unpacker = None
        self.plain = bytes(self.content[:2]) != b"\x1f\x8b"
        self.broken = 0

    def readable(self) -> bool:
        return True

    def _next(self) -> bytes:
        piece = self.content[self.at : self.at + INFLATED_BYTES]
        self.at += len(piece)
        if self.plain:
            return bytes(piece)
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(31)
        try:
            out = self.unpacker.decompress(piece)
        except zlib.error:
            self.broken += 1
            self.unpacker = None
            # the member begins in this piece or before; go on after its start, where the next one may be
            found = bytes(self.content[self.at - len(piece) + 1 : self.at + 2]).find(b"\x1f\x8b\x08")
            if found >= 0:
                self.at = self.at - len(piece) + 1 + found
            return b"\r\n"
        if self.unpacker.eof:
            rest = self.unpacker.unused_data.lstrip(b"\0")
            self.at -= len(rest)
            self.unpacker = None
        return out

    def readinto(self, buffer) -> int:
        while not self.ready and self.at < len(self.content):
            self.ready = self._next()
        n = min(len(buffer), len(self.ready))
        buffer[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def _block(stream, n: int) -> bytes:
    """``n`` bytes, or what there is; never asks for more memory than that."""
    parts, left = [], n
    while left and (part := stream.read(min(left, READ_BYTES))):
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def parse(stream) -> Iterator[tuple[dict, bytes | None, str | None]]:
    """Header fields (names in lower case), block and fault of each record in a stream of plain bytes.

    A record with a fault has no block. Lines that belong to no record, a header without a line end or with a
    length that is no number, and a block that ends early are faults; reading goes on at the next line that
    begins a record, which after a block that ends early is looked for in the block.
    """
    lost = False
    while line := stream.readline(READ_BYTES):
        if not line.startswith(b"WARC/"):
            if line.strip() and not lost:
                lost = True
                yield {}, None, "bytes outside of a record"
            continue
        lost, head, ended = False, {}, False
        while field := stream.readline(READ_BYTES):
            if ended := field in (b"\r\n", b"\n"):
                break
            key, _, value = field.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        length = head.get("content-length", "")
        if not ended or not _NUMBER.fullmatch(length):
            lost = True
            yield head, None, "no end of the header" if not ended else "no length"
            continue
        block = _block(stream, int(length))
        if len(block) < int(length):
            yield head, None, "ends before its length"
            yield from parse(io.BytesIO(block[block.find(b"\nWARC/") + 1 or len(block) :]))
            return
        yield head, block, None


_SEGMENT = "origin string, number long, total long, record_type string, refers_to string, digest string, fields map<string,string>, block binary"
_RECORD = "record_id string, record_type string, refers_to string, digest string, fields map<string,string>, complete boolean, fault string, payload_bytes long, payload_digest string"


def _finished(kind: str, block: bytes | None, fault: str | None, keep: bool) -> dict:
    payload = None if block is None or kind == "revisit" else payload_of(block)
    ok = payload is not None or kind == "revisit" and block is not None
    out = {"complete": ok, "fault": fault or (None if ok else "broken framing"), "payload_bytes": None if payload is None else len(payload), "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest()}
    return out | ({"payload": payload} if keep else {})


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit in the archives under ``path``, segments put together.

    record_id, record_type, refers_to (a revisit's origin), digest (as the archive states it), fields
    (all header fields, names in lower case), complete, payload_bytes and payload_digest (SHA-256), and
    with ``payloads`` the payload. A record is complete if its segments are numbered from 1 without a
    gap, the last states the total length, the lengths add up to it and the framing is whole; else its
    payload columns are null. Of segments repeated with one number one counts. A revisit has null payload
    columns. An empty folder of archives gives no rows. Whatever can't be read as a record is a row with
    complete = false, record_type 'invalid' and its fault; the records after it are read.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    schema = _RECORD + (", payload binary" if payloads else "")
    segment_type, record_type = (T._parse_datatype_string(s) for s in (_SEGMENT, schema))
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")

    def rows(it, arrow, limit=SLICE_BYTES):
        import pyarrow as pa

        out, size = [], 0
        for row, n in it:
            out.append(row)
            size += n + 400
            if size > limit:
                yield from pa.Table.from_pylist(out, arrow).to_batches()
                out, size = [], 0
        if out:
            yield from pa.Table.from_pylist(out, arrow).to_batches()

    def parsed(batches, whole: bool):
        for batch in batches:
            for content in batch.column(0):
                for head, block, fault in parse(io.BufferedReader(Inflated(content.as_buffer()), 1 << 20)):
                    kind = head.get("warc-type", "")
                    base = {"record_type": kind, "refers_to": head.get("warc-refers-to"), "digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None, "fields": list(head.items())}
                    number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
                    if fault is None and not (number is None or _NUMBER.fullmatch(number)) or not (total is None or _NUMBER.fullmatch(total)):
                        fault = "a segment's number is none"
                    if fault is not None:
                        if whole:
                            yield base | {"record_type": "invalid", "record_id": head.get("warc-record-id")} | _finished("", None, fault, payloads), 0
                        continue
                    if (number is not None) == whole or kind not in ("response", "revisit", "continuation"):
                        continue
                    if whole:
                        yield base | {"record_id": head.get("warc-record-id")} | _finished(kind, block, None, payloads), len(block) * payloads
                    else:
                        yield base | {"origin": head.get("warc-segment-origin-id", head.get("warc-record-id")), "number": int(number), "total": total and int(total), "block": block}, len(block)

    def whole_records(batches):
        yield from rows(parsed(batches, True), to_arrow_schema(record_type))

    def segments(batches):
        yield from rows(parsed(batches, False), to_arrow_schema(segment_type))

    def assemble(batches):
        def each():
            for batch in batches:
                for r in batch.to_pylist():
                    pieces = {}
                    for s in r["segments"]:
                        pieces.setdefault(s["number"], s)
                    numbers = sorted(pieces)
                    first, last = pieces[numbers[0]], pieces[numbers[-1]]
                    block = b"".join(pieces[k]["block"] for k in numbers)
                    gap, wrong = numbers != list(range(1, len(numbers) + 1)), last["total"] != len(block)
                    fault = "segments are missing" if gap or last["total"] is None else "its length isn't the total" if wrong else None
                    kind = first["record_type"]
                    own = {k: first[k] for k in ("record_type", "refers_to", "digest", "fields")}
                    yield own | {"record_id": r["origin"]} | _finished(kind, None if fault else block, fault, payloads), len(block) * payloads

        yield from rows(each(), to_arrow_schema(record_type))

    single = files.mapInArrow(whole_records, schema)
    grouped = files.mapInArrow(segments, _SEGMENT).groupBy("origin").agg(F.collect_list(F.struct("number", "total", "record_type", "refers_to", "digest", "fields", "block")).alias("segments"))
    return single.unionByName(grouped.mapInArrow(assemble, schema))


def _record_id(page: Column, digest: Column, copy: Column) -> Column:
    name = F.sha2(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest, copy.cast("string")), 256)
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def deduplicated(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Records for :func:`write` from ``pages`` (page_id, url, html): of equal payloads of ``least_bytes``
    or more the one with the smallest page_id is the response, the others revisit it.

    The payload is the html in UTF-8, empty for null. Of rows repeated with one page_id one counts as the
    smallest, the others revisit it; a null page_id is larger than all others.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    # one name for page and payload: the join and the grouping below then share one exchange of the payloads
    keyed = keyed.withColumn("key", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    slim = keyed.select("key", "page_id", "digest", F.octet_length("payload").alias("n"))
    kinds = slim.groupBy("key", "page_id", "digest", "n").agg(F.count("*").alias("copies"))
    first = kinds.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("copies").alias("all")).filter("all > 1")
    kinds = kinds.join(first, "digest", "left").select("key", "copies", "first", "all")
    rows = keyed.join(kinds, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("page_id", "digest", "url", "payload", "copies", "first", "all")])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    response = F.col("all").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return rows.select(
        _record_id(F.col("page_id"), F.col("digest"), F.col("copy")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, _record_id(F.col("first"), F.col("digest"), F.lit(1))).alias("refers_to"),
        "digest",
        F.create_map(F.lit("WARC-Date"), F.lit("2000-01-01T00:00:00Z"), F.lit("WARC-Target-URI"), F.col("url"), F.lit("Page-Id"), F.col("page_id").cast("string")).alias("fields"),
        F.when(response, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, least_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back: one row per page.

    page_id (of any type that has a text form), payload_bytes, payload_digest (both as read; a revisit's come from the response it refers
    to), record_type, refers_to (that response's page_id) and complete. Extra columns are ignored; see
    :func:`deduplicated` for nulls and repeated rows. An empty table gives no rows.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write(deduplicated(pages, least_bytes), path, segment_bytes)
    got = read(spark, path).select("record_id", "record_type", "refers_to", "complete", "payload_bytes", "payload_digest", F.col("fields")["page-id"].cast(kind).alias("page_id"))
    got = scratch.save(got, "read")
    origin = got.filter("record_type = 'response'").select(F.col("record_id").alias("o"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"), F.col("complete").alias("of_complete"))
    revisits = got.filter("record_type = 'revisit'").join(origin, F.col("refers_to") == F.col("o"), "left")
    revisits = revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to"), F.coalesce("of_complete", F.lit(False)).alias("complete"))
    responses = got.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"), "complete")
    return responses.unionByName(revisits)
