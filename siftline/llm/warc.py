"""WARC archives: writing pages as records with segments, and reading them back.

A page is an HTTP response in chunked transfer framing. Blocks over ``segment`` bytes are cut
into a first record and continuation records, which name the first as their origin. Pages with
equal payloads share one response, which the others revisit.

Each record is a gzip member of its own, so what is damaged loses one record: reading goes on at the
next member. Reading takes each file in one task, once, record by record; files hold at most RECORDS
records of at most ``segment`` bytes. Records that are whole are decoded at once. Segments, from whatever
files, are grouped by origin identifier, put in order of their numbers, verified against the
total length in the last one, joined and decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, thrifty

#: Bytes of a block from which records are segmented; bytes of a chunk; records in a file.
SEGMENT, CHUNK, RECORDS = 64_000, 8_192, 4_000
#: Any fixed date does: pages have none.
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1a9a52-6a8e-4a52-9d0c-0b8a3e1c7d55")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """``payload`` in chunked transfer framing, the closing empty chunk included."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join((*parts, b"0\r\n\r\n"))


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over. Raises ValueError if broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block; None if its chunked framing is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None


def _record(kind: str, name: str, block: bytes, **more: str | None) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": _DATE, **{k.replace("_", "-"): v for k, v in more.items()}}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}')}>"


def records_of(page_id: int | None, row: int, url: str | None, payload: bytes, of: tuple | None, segment: int) -> Iterator[bytes]:
    """The records of a page, without the two line ends that close each; ``of``: what it revisits."""
    name = _name(page_id, row)
    line = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    common = {
        "WARC_Target_URI": None if url is None else line(url), "X_Page_ID": None if page_id is None else str(page_id),
        "Content_Type": "application/http;msgtype=response", "WARC_Payload_Digest": f"sha1:{base32_sha1(payload)}",
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if of is not None:
        yield _record("revisit", name, head, **common, WARC_Profile=_PROFILE, WARC_Refers_To=_name(*of), X_Refers_To_Page_ID=None if of[0] is None else str(of[0]))
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record("response", name, block, **common)
        return
    yield _record("response", name, block[:segment], **common, WARC_Segment_Number="1")
    last = -(-len(block) // segment)
    for k in range(2, last + 1):
        total = str(len(block)) if k == last else None
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}/{k}')}>"
        yield _record("continuation", own, block[(k - 1) * segment : k * segment], WARC_Segment_Origin_ID=name, WARC_Segment_Number=str(k), WARC_Segment_Total_Length=total)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, segment: int = SEGMENT
) -> None:
    """Write a record per row of ``pages`` as gzip'd WARC files in the folder ``path``.

    Of rows with equal payloads of ``least`` bytes or more the one with the largest id (of
    repeated ids one) is the response and the rest revisit it; other rows are responses. A
    null text is an empty payload; a null url or id is left out of the record's head. Files are
    Spark's part files: a gzip member for each record, a zero byte after each, as gzip allows.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    each = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"),
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("same", F.sha1("payload"))
    # numbered once: a task that is done again must not give its rows other numbers
    each = materialise(each, "pages")
    big = each.where(F.octet_length("payload") >= least).select("same", F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("o"), "id", "row").alias("who"))
    shared = big.groupBy("same").agg(F.count("*").alias("n"), F.max("who").alias("who")).where("n > 1")
    # written first, so that its size decides how it is joined: where it is small no page moves
    shared = materialise(shared.select("same", F.col("who.id").alias("of_id"), F.col("who.row").alias("of_row")), "shared")
    joined = each.join(shared, "same", "left").select("id", "url", "payload", "row", "of_id", "of_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                out: list[bytes] = []
                for r in batch.slice(at, 512).to_pylist():
                    theirs = None if r["of_row"] is None or r["of_row"] == r["row"] or len(r["payload"]) < least else (r["of_id"], r["of_row"])
                    out += (gzip.compress(x + b"\r\n\r\n", 6, mtime=0) for x in records_of(r["id"], r["row"], r["url"], r["payload"], theirs, segment))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    # members are bytes, which a string column holds as they are
    lines.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS).text(path)


#: What tells that an archive is damaged.
_BROKEN = (ValueError, KeyError, EOFError, OSError, zlib.error)
#: Bytes of a gzip member that are checked as a whole before a record of it is given out.
_WHOLE = 1 << 20


class _Member(io.RawIOBase):
    """One gzip member of ``content``, read piece by piece; ``end`` is where it stops."""

    def __init__(self, content: bytes, start: int):
        self.content, self.at, self.held, self.end = content, start, b"", None
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held and self.end is None:
            piece = self.content[self.at : self.at + (1 << 16)]
            if not piece:
                raise EOFError("a member is cut short")
            self.held = self.inflate.decompress(piece)
            self.at += len(piece)
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def _records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """(fields, block) of each record of a WARC file, gzip'd or plain; None for each damaged stretch.

    After damage reading goes on at the next member that begins with a record, or at the next record
    of a plain file that follows an empty line.
    """
    if content[:2] != b"\x1f\x8b":
        at = 0
        while 0 <= at < len(content):
            f = io.BytesIO(content)
            f.seek(at)
            begun = at
            try:
                for found in _records(f):
                    begun = f.tell()
                    yield found
                return
            except _BROKEN:
                yield None
                next_one = content.find(b"\r\n\r\nWARC/", begun + 1)
                at = next_one + 4 if next_one >= 0 else -1
        return
    at = 0
    while True:
        while at < len(content) and content[at] in b"\0\r\n":
            at += 1
        if at >= len(content):
            return
        try:
            member = _Member(content, at)
            # a member of usual size is checked to its end first; a longer one, of many records, is read as it comes
            start = io.BufferedReader(member, 1 << 18).read(_WHOLE)
            if member.end is not None and not member.held:
                yield from list(_records(io.BytesIO(start)))
            else:
                member = _Member(content, at)
                f = io.BufferedReader(member, 1 << 18)
                yield from _records(f)
            at = member.end
        except _BROKEN:
            yield None
            at = content.find(b"\x1f\x8b\x08", at + 1)
            while at >= 0 and not _begins_a_record(content, at):
                at = content.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return


def _begins_a_record(content: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(content[at : at + 4096], 5) == b"WARC/"
    except zlib.error:
        return False


_READ = "record_id string, page_id long, url string, record_type string, refers_to long, refers_id string, segment int, total long, stated_digest string, payload binary, payload_bytes long, payload_digest string"


def _read_files(payloads: bool):
    names = [part.split()[0] for part in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    number = lambda x: None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for found in parse(content.as_py()):
                    try:
                        f, block = found or ({}, b"")
                        kind, part = f["warc-type"], number(f.get("warc-segment-number"))
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        payload = None if kind == "revisit" else payload_of(block) if part is None else block
                        whole = payload is not None and part is None
                        rows.append((
                            f.get("warc-segment-origin-id", f["warc-record-id"]), number(f.get("x-page-id")), f.get("warc-target-uri"), kind,
                            number(f.get("x-refers-to-page-id")), f.get("warc-refers-to"), part, number(f.get("warc-segment-total-length")),
                            f.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload if payloads or part is not None else None,
                            len(payload) if whole else None, base32_sha1(payload) if whole else None,
                        ))
                        held += len(payload or b"")
                        if held > 1 << 22:
                            yield batch_of(rows)
                            rows, held = [], 0
                    except _BROKEN:  # nothing to read, or a head that makes no sense
                        rows.append((None, None, None, "damaged", *[None] * 8))
                if rows:
                    yield batch_of(rows)

    return run


def _joined(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Payloads from segments in order; null where one is missing or the length is wrong."""
        for batch in batches:
            for at in range(0, len(batch), 16):
                part, found = batch.slice(at, 16), []
                for pieces, total in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    by = {p["segment"]: p["payload"] for p in pieces}
                    block = b"".join(by[k] for k in sorted(by))
                    one = all(by[p["segment"]] == p["payload"] for p in pieces)
                    found.append(payload_of(block) if one and sorted(by) == list(range(1, len(by) + 1)) and len(block) == total else None)
                sizes = pa.array([None if p is None else len(p) for p in found], pa.int64())
                digests = pa.array([None if p is None else base32_sha1(p) for p in found], pa.string())
                kept = pa.array(found if payloads else [None] * len(found), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), kept, sizes, digests], ["record_id", "payload", "payload_bytes", "payload_digest"])

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit record of the WARC files in the folder ``path``.

    record_id, page_id, url, record_type, refers_to (page), refers_id (record), stated_digest,
    payload (null unless ``payloads``), payload_bytes, payload_digest (of the payload as read).
    A revisit has neither payload nor digest of its own. A segmented record that lacks a
    segment, or whose length isn't the total that it states, has a null payload; so has one
    whose chunked framing is broken, and one of whose segments two with different bytes are there
    (equal ones count once). Each stretch that is damaged, cut short say, or without a record where one should
    start, gives a row of the type ``damaged`` that is null otherwise; records before and after it are
    read, but for those of the same gzip member after it. An empty folder gives an empty table.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = materialise(files.mapInArrow(thrifty(_read_files(payloads)), _READ), "records")
    whole, parts = records.where("segment IS NULL"), records.where("segment IS NOT NULL")
    sets = parts.groupBy("record_id").agg(F.collect_list(F.struct("segment", "payload")).alias("pieces"), F.max("total").alias("total"))
    again = sets.mapInArrow(thrifty(_joined(payloads)), "record_id string, payload binary, payload_bytes long, payload_digest string")
    heads = parts.where("record_type != 'continuation'").drop("payload", "payload_bytes", "payload_digest").join(again, "record_id", "left")
    names = ["record_id", "page_id", "url", "record_type", "refers_to", "refers_id", "stated_digest", "payload", "payload_bytes", "payload_digest"]
    return whole.select(*names).union(heads.select(*names))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive's pages."""
    flat = read_archives(spark, path, payloads=False).select("record_id", "page_id", "record_type", "refers_to", "refers_id", "payload_bytes", "payload_digest")
    flat = materialise(flat, "pages-read")
    named = flat.where("record_type = 'response'").select(F.col("record_id").alias("rid"), F.col("payload_bytes").alias("rb"), F.col("payload_digest").alias("rd"))
    seen = flat.where("record_type = 'revisit'")
    seen = seen.join(named, F.col("refers_id") == F.col("rid"), "left").select("page_id", F.col("rb").alias("payload_bytes"), F.col("rd").alias("payload_digest"), "record_type", "refers_to")
    return flat.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").union(seen)


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT, least: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` to a new folder among the shared ones and read them back (``digest``)."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment=segment, least=least, **columns)
    return digest(pages.sparkSession, path)
