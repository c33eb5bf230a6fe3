"""WARC archives: writing with segmentation, and reassembly of segmented records.

Writing: every page becomes a ``response`` record (HTTP head, body in chunked transfer framing) or,
where an equal payload is stored under a larger page_id, a ``revisit`` record that refers to it.
Blocks longer than ``segment_bytes`` are split into a first record and ``continuation`` records that
name their origin, their number and, in the last one, the total length. Spark's text sink stores the
records, gzip-compressed, in files of a bounded number of records in the shared folder.

Reading: archives are parsed as byte streams by their Content-Length. Segments are grouped by the
origin's identifier, ordered by segment number, joined, and checked: numbers 1..n without a gap, and the
sum of lengths equal to the stated total. Then the chunked framing is decoded. As with a partial
aggregation, the groups that one file holds whole are joined there; only the segments of records that
go over several files are shuffled.

Defined results: null html is an empty payload; a null page_id is written as 'null' and loses against
any other; rows repeated with one page_id and payload are records of their own of the same type, as every
written row has its own record identifier (the number of the row in its task, with the page_id; a
revisit's WARC-Refers-To names the page only); an
incomplete or badly framed record is returned with ``complete`` false; a record stored twice may be returned
twice; an empty table gives an empty
result; columns other than page_id and html (url for the target) are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, text_of, written

CRLF = b"\r\n"
SEGMENT_BYTES = 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 2048
HELD_BYTES = 8 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, page_id long, record_type string, origin string, segment int, total long, refers_to long, stated_digest string, block binary"
DECODED = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, complete boolean"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The body of a chunked message; None where the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            return None
        try:
            n = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        at = end + 2 + n
        if n < 0 or framed[at : at + 2] != CRLF:
            return None
        out.append(framed[end + 2 : at])
        at += 2


def head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def records_of(page_id: str, url: str, payload: bytes, refers_to: str | None, segment_bytes: int, part: str = "0") -> Iterator[bytes]:
    """The WARC records of one page, each without its closing blank lines; ``part`` tells rows with one page_id apart."""
    own = f"<urn:row:{part}:page:{page_id}>"
    named = [("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if refers_to is not None:
        block = HTTP_HEAD
        extra = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield head([("WARC-Type", "revisit"), *named, *extra], len(block)) + block
        return
    block = HTTP_HEAD + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, piece in enumerate(pieces, 1):
        if k == 1:
            fields = [("WARC-Type", "response"), *named, *([("WARC-Segment-Number", "1")] if len(pieces) > 1 else [])]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:row:{part}:segment:{k}:page:{page_id}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
            fields += [("WARC-Segment-Total-Length", str(len(block)))] if k == len(pieces) else []
        yield head(fields, len(piece)) + piece


def _frame(segment_bytes: int):
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for page_id, url, html, to, revisit in zip(b["page_id"], b["url"], b["html"], b["refers_to"], b["revisit"], strict=True):
                url = "".join(url.split()) or "about:blank"
                out += records_of(page_id, url, html.encode(), to if revisit else None, segment_bytes, str(row))
                row += 1
            yield pd.DataFrame({"record": out})

    return run


def plan_records(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """page_id, url, html and for revisits the page_id of the response.

    The table of winners holds only payloads that occur more than once, so it is often small enough
    to be broadcast; otherwise the join is shuffled and hot digests are split by Spark.
    """
    rows = pages.select("page_id", text_of("url").alias("url") if "url" in pages.columns else F.lit("").alias("url"), text_of("html").alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    large = keyed.where(F.col("size") >= min_revisit_bytes)
    winners = large.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    winners = written(winners.select("digest", "response_id"))
    rows = keyed.join(winners.withColumn("shared", F.lit(True)), "digest", "left")
    again = (F.col("size") >= min_revisit_bytes) & F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return rows.select(named("page_id").alias("page_id"), "url", "html", named("response_id").alias("refers_to"), again.alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    records = plan_records(pages, min_revisit_bytes).mapInPandas(_frame(segment_bytes), "record binary")
    out = records.select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Reads a gzip stream of one or more members, or plain bytes, piece by piece."""

    def __init__(self, content: bytes):
        self.raw = io.BytesIO(content)
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)
        self.buffer = b""

    def more(self) -> bool:
        piece = self.raw.read(1 << 18)
        if not piece:
            return False
        if not self.packed:
            self.buffer += piece
            return True
        while piece:
            self.buffer += self.inflate.decompress(piece)
            piece = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            else:
                break
        return True

    def upto(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def parse(content: bytes) -> Iterator[dict]:
    stream = _Stream(content)
    while True:
        while stream.buffer[:2] == CRLF or (len(stream.buffer) < 2 and stream.more()):
            if stream.buffer[:2] == CRLF:
                stream.buffer = stream.buffer[2:]
        top = stream.upto(b"\r\n\r\n")
        if top is None:
            return
        fields = dict(line.split(": ", 1) for line in top.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        block = stream.take(int(fields.get("Content-Length", 0)))
        page = (fields.get("WARC-Segment-Origin-ID") or fields.get("WARC-Record-ID", "")).strip("<>").rpartition(":")[2]
        to = fields.get("WARC-Refers-To", "").strip("<>").rpartition(":")[2]
        number = lambda k: int(fields[k]) if k in fields else None
        yield {
            "record_id": fields.get("WARC-Record-ID"),
            "page_id": int(page) if page.lstrip("-").isdigit() else None,
            "record_type": fields.get("WARC-Type"),
            "origin": fields.get("WARC-Segment-Origin-ID"),
            "segment": number("WARC-Segment-Number"),
            "total": number("WARC-Segment-Total-Length"),
            "refers_to": int(to) if to.lstrip("-").isdigit() else None,
            "stated_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
            "block": block,
        }


def _parse_files(batches):
    names = [c.split()[0] for c in PARSED.split(", ")]
    for b in batches:
        for content in b["content"]:
            rows, held = [], 0
            for r in parse(content):
                rows.append(r)
                held += len(r["block"])
                if held > 8 << 20:
                    yield _typed(pd.DataFrame(rows, columns=names))
                    rows, held = [], 0
            if rows:
                yield _typed(pd.DataFrame(rows, columns=names))


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({"page_id": "Int64", "segment": "Int32", "total": "Int64", "refers_to": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse_files, PARSED)


def unframed(block: bytes, kind: str | None, stated: str | None, whole: bool) -> tuple[bytes | None, int | None, str | None, bool]:
    """(payload, its length, its digest, complete) of a logical record's block; revisits have no payload."""
    if kind == "revisit":
        return None, None, stated, whole
    top, _, body = block.partition(b"\r\n\r\n")
    data = dechunked(body) if b"transfer-encoding: chunked" in top.lower() else body
    if data is None:
        return None, None, None, False
    digest = digest32(data)
    return data, len(data), digest, whole and (not stated or stated == digest)


class Assembler:
    """Joins the segments that lie in one archive file; the rest is left for the shuffle.

    A record is whole when its numbers run from 1 to that of the segment with the total length, and
    the lengths add up to it. Segments wait until ``HELD_BYTES`` are held or the file ends.
    """

    def __init__(self, keep_payload: bool):
        self.keep_payload = keep_payload
        self.open: dict[str, dict[int, dict]] = {}
        self.last: dict[str, dict] = {}  # by origin, the segment that states the total length
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, r: dict) -> None:
        self.held += len(r["block"])
        if r["segment"] is None:
            self.whole(r, r["block"])
            return
        origin = r["origin"] or r["record_id"]
        parts = self.open.setdefault(origin, {})
        if r["segment"] in parts:
            self.loose(r)
            return
        parts[r["segment"]] = r
        if r["total"] is not None:
            self.last[origin] = r
        last = self.last.get(origin)
        if last and last["segment"] == len(parts) and 1 in parts:
            block = b"".join(parts[k]["block"] for k in sorted(parts))
            if len(block) == last["total"] and max(parts) == len(parts):
                self.whole(parts[1], block)
                del self.open[origin], self.last[origin]

    def whole(self, first: dict, block: bytes) -> None:
        data, size, digest, right = unframed(block, first["record_type"], first["stated_digest"], True)
        self.rows.append((first["page_id"], first["record_type"], first["refers_to"], data if self.keep_payload else None, size, digest, right) + (None,) * 6)

    def loose(self, r: dict) -> None:
        self.rows.append((r["page_id"], r["record_type"], r["refers_to"], None, None, None, None) + tuple(r[k] for k in ("record_id", "origin", "segment", "total", "stated_digest", "block")))

    def out(self) -> pd.DataFrame:
        for parts in self.open.values():
            for r in parts.values():
                self.loose(r)
        frame = pd.DataFrame(self.rows, columns=[c.split()[0] for c in (DECODED + SEGMENT_COLUMNS).split(", ")])
        self.open, self.last, self.rows, self.held = {}, {}, [], 0
        return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "segment": "Int32", "total": "Int64"})


def _assembled(keep_payload: bool):
    def run(batches):
        for b in batches:
            for content in b["content"]:
                joined = Assembler(keep_payload)
                for r in parse(content):
                    joined.add(r)
                    if joined.held > HELD_BYTES:
                        yield joined.out()
                yield joined.out()

    return run


def _decode(keep_payload: bool):
    """Unframes the records that the shuffle has joined."""
    names = [c.split()[0] for c in DECODED.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                data, size, digest, right = unframed(bytes(r.block), r.record_type, r.stated_digest, bool(r.whole))
                out.append((r.page_id, r.record_type, r.refers_to, data if keep_payload else None, size, digest, right))
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return run


SEGMENT_COLUMNS = ", record_id string, origin string, segment int, total long, stated_digest string, block binary"


def reassembled(parts: DataFrame) -> DataFrame:
    """Segments to logical records: page_id, record_type, refers_to, stated_digest, block, whole."""
    parts = parts.withColumn("origin", F.coalesce("origin", "record_id"))
    part = F.struct("segment", F.col("block").cast("string").alias("bytes"))
    first = F.col("segment") == 1
    rows = parts.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max(F.when(first, F.col("record_type"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"),
        F.max(F.when(first, F.col("stated_digest"))).alias("stated_digest"),
        F.sort_array(F.collect_set(part)).alias("parts"),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["bytes"]), "").cast("binary")
    whole = (F.size("parts") == F.col("last")) & (F.octet_length(block) == F.col("total"))
    return rows.select("page_id", F.coalesce("record_type", F.lit("response")).alias("record_type"), "refers_to", "stated_digest", block.alias("block"), F.coalesce(whole, F.lit(False)).alias("whole"))


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The archive's records with their payloads: reassembled, verified and unframed.

    The archives are parsed once. Segments that lie in one file are joined where it is read, before
    any shuffle; those of records that go over several files are kept in a table and joined from there.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = written(files.mapInPandas(_assembled(keep_payload), DECODED + SEGMENT_COLUMNS))
    single = parsed.where("segment is null").select(*(c.split()[0] for c in DECODED.split(", ")))
    joined = reassembled(parsed.where("segment is not null")).mapInPandas(_decode(keep_payload), DECODED)
    return single.unionByName(joined)


def resolved(pages: DataFrame) -> DataFrame:
    """Revisits get the length of the payload they refer to."""
    pages = written(pages.drop("payload"))
    target = pages.where("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).distinct()
    again = pages.where("record_type = 'revisit'")
    again = again.join(written(target), (F.col("refers_to").eqNullSafe(F.col("__id"))) & (F.col("payload_digest") == F.col("__digest")), "left")
    again = again.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", (F.col("complete") & F.col("__bytes").isNotNull()).alias("complete"))
    return pages.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete").unionByName(again)


def op1_warc_segments(spark, sf_dir):
    path = f"{shared_folder(spark)}.warc"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_pages(spark, path, keep_payload=False))


QUERIES = {"op1_warc_segments": op1_warc_segments}
