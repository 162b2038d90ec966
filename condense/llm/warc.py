"""WARC archives: write pages as segmented records, read them back and reassemble them.

Writing: each page gives one ``response`` record whose block is an HTTP response in
chunked transfer framing, or a ``revisit`` if a page with a smaller id has an equal
payload. A block longer than ``segment_bytes`` is cut: the first part stays in the
response with segment number 1, the others become ``continuation`` records that
name their origin; the last one also says the total length. Files are gzipped and
written by Spark, so they may lie in any file system; a task writes its responses into one file and the
continuations, dealt by segment number, into ``SLOTS`` others, so a record lies in several
files without a shuffle.

Which pages are revisits is decided on digests alone. Payloads are only
shuffled where their digest may be that of an earlier page: a bit map of fixed size, filled
from the revisits' digests, tells which can't be.

Reading: a file is a stream of pieces between blank lines; records are put together
by their Content-Length, so a payload may hold blank lines or texts that look like
records, and a task holds one record at a time. Continuations are grouped by the
identifier of their origin, ordered by segment number and joined; the total length
is verified, then the chunked framing is decoded and the payload's digest verified.

Defined results: a NULL payload is an empty one; a NULL url is an empty target; line
ends in a url are written as %0D and %0A. A page without id is always a response.
Repeated rows with the smallest id are all responses. A record of which a segment
is missing or too long, or whose digest differs, has no payload and says so in
``error``. What can't be read in a file (no head of a record, a block that is cut short or too long) becomes a
row of kind ``damaged`` with its ``error``, and reading goes on at the next head. Very long payloads are cut as others are.
An empty table gives an archive without records. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from condense.llm.rows import arrow_schema, field, map_runs, pieces
from condense.session import ship, written

SEGMENT_BYTES = 256 * 1024
CHUNK_BYTES = 16 * 1024
SLOTS = 3
#: Bits of the map of digests that occur more than once.
MAP_BITS = 20
DATE = "2024-01-01T00:00:00Z"

BREAK = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + BREAK


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + BREAK


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without line end")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without line end")
        out.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields).encode() + BREAK


def page_records(
    name: str, page: int | None, url: str, payload: bytes, first: int | None, segment: int, chunk: int
) -> Iterator[tuple[int, bytes]]:
    """The records of one page, each with its slot; ``name`` makes its identifier unique."""
    said: list[tuple[str, object]] = [
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}:{name}>"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if first is not None:
        said += [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
        yield 0, _head([*said, ("Content-Length", len(HTTP))]) + HTTP
        return
    block = HTTP + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    said += [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]
    if len(parts) > 1:
        said.append(("WARC-Segment-Number", 1))
    yield 0, _head([*said, ("Content-Length", len(parts[0]))]) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        more: list[tuple[str, object]] = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}:{name}-{n}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", said[0][1]),
            ("WARC-Segment-Number", n),
        ]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield 1 + n % SLOTS, _head([*more, ("Content-Length", len(part))]) + part


def marks(digests: DataFrame) -> bytes:
    """A bit map of the digests (hex), at most ``2 ** MAP_BITS`` numbers on their way to the driver."""
    place = F.conv(F.substring("sha1", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    held = bytearray(1 << (MAP_BITS - 3))
    for row in digests.select(place.alias("place")).distinct().collect():
        held[row["place"] >> 3] |= 1 << (row["place"] & 7)
    return bytes(held)


def may_repeat(sha1: Column, held: bytes) -> Column:
    """Whether the map says that a digest (hex) may be one of those it was filled from."""
    place = F.conv(F.substring(sha1, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    byte = F.hex(F.substring(F.lit(held), F.shiftright(place, 3).cast("int") + 1, F.lit(1)))
    return F.getbit(F.conv(byte, 16, 10).cast("int"), place.bitwiseAND(F.lit(7)).cast("int")) == 1

def write(
    df: DataFrame,
    path: str,
    id_column: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write an archive of ``df``; payloads shorter than ``least_bytes`` are never revisits."""
    ship(df.sparkSession)
    pages = df.select(
        F.col(id_column).cast("long").alias("page"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    narrow = pages.filter(F.octet_length("payload") >= least_bytes).select("page", F.sha1("payload").alias("sha1"))
    narrow = written(narrow.filter(F.col("page").isNotNull()), "warc-digests")
    firsts = narrow.groupBy("sha1").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    later = narrow.join(firsts.select("sha1", "first"), "sha1").filter(F.col("page") != F.col("first"))
    later = written(later.select("page", "sha1", "first").distinct(), "warc-revisits")
    held = marks(later)
    digest = F.sha1("payload")
    # a NULL page never repeats one: it has no place in the order
    able = F.col("page").isNotNull() & may_repeat(digest, held)
    alone = pages.filter(~able).withColumn("first", F.lit(None).cast("long"))
    met = pages.filter(able).withColumn("sha1", digest).join(later, ["page", "sha1"], "left").drop("sha1")
    fields = [field("slot", "int"), field("value", "binary")]
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "payload", 8_000_000):
                made = []
                for page, at, body, first in zip(*(c.to_pylist() for c in part.columns)):
                    n += 1
                    made += page_records(f"{task:x}.{n:x}", page, at, body, first, segment_bytes, chunk_bytes)
                columns = zip(*made) if made else [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # numbers of the tasks of both halves stay apart, as one union has all their partitions
    records = alone.unionByName(met).mapInArrow(run, T.StructType(fields))
    records = records.select("slot", F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", BREAK.decode()).option("compression", "gzip").partitionBy("slot").text(path)


RECORD = [
    field("record", "string"),
    field("kind", "string"),
    field("number", "int"),
    field("total", "long"),
    field("refers", "string"),
    field("digest", "string"),
    field("url", "string"),
    field("block", "binary"),
    field("error", "string"),
]

DAMAGED = "damaged"


def parse(pieces_of_file: Iterable[bytes]) -> Iterator[tuple]:
    """Records of one file, given the texts between its blank lines; what is no record becomes a damaged one."""
    rest = iter(pieces_of_file)
    head = next(rest, None)
    while head is not None:
        if not head:
            head = next(rest, None)
            continue
        said: dict[str, str] = {}
        if head.startswith(b"WARC/"):
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            said = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        name = said.get("warc-segment-origin-id", said.get("warc-record-id"))
        number, total = said.get("warc-segment-number"), said.get("warc-segment-total-length")
        counts = [said.get("content-length"), number or "0", total or "0"]
        if name is None or "warc-type" not in said or not all(c is not None and c.isascii() and c.isdigit() for c in counts):
            yield _damaged(name, f"no head of a record: {head[:40]!r}")
            head = _next_head(rest)
            continue
        length, parts, have = int(counts[0]), [], -len(BREAK)
        while have < length:
            part = next(rest, None)
            if part is None:
                break
            parts.append(part)
            have += len(BREAK) + len(part)
        block, after = BREAK.join(parts), b""
        if have > length:
            # a block that ends in a line end makes the first blank line seen begin within it
            block, after = block[:length], block[length:]
        if have < length or after and not after.startswith(BREAK):
            yield _damaged(name, f"a block of {length} bytes {'is cut short' if have < length else 'ends inside a piece'}")
            # the piece that went too far may be the head of the next record
            head = parts[-1] if parts and have > length and parts[-1].startswith(b"WARC/") else _next_head(rest)
            continue
        yield (
            name.strip("<>"),
            said["warc-type"],
            int(number) if number else None,
            int(total) if total else None,
            said["warc-refers-to"].strip("<>") if "warc-refers-to" in said else None,
            said.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            said.get("warc-target-uri"),
            block,
            None,
        )
        head = after[len(BREAK) :] if after else next(rest, None)


def _damaged(name: str | None, error: str) -> tuple:
    return (name.strip("<>") if name else None, DAMAGED, None, None, None, None, None, b"", error)


def _next_head(rest: Iterator[bytes]) -> bytes | None:
    # the line end before a head may be that of the block which can't be read
    return next((piece.removeprefix(b"\r\n") for piece in rest if piece.startswith((b"WARC/", b"\r\nWARC/"))), None)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archive at ``path``, as they lie in its files."""
    ship(spark)
    schema = arrow_schema(RECORD)
    lines = spark.read.option("lineSep", BREAK.decode()).text(path)
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())

        def made(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema
            )

        stream, held, size = _by_file(rows()), [], 0
        for texts in stream:
            for record in parse(texts):
                held.append(record)
                size += len(record[-2])
                if size > 4_000_000:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return named.mapInArrow(run, T.StructType(RECORD))


def _by_file(rows: Iterable[tuple[str, bytes]]) -> Iterator[Iterator[bytes]]:
    for _, group in groupby(rows, key=lambda r: r[0]):
        yield (value for _, value in group)


PAGE = [
    field("record", "string"),
    field("kind", "string"),
    field("refers", "string"),
    field("digest", "string"),
    field("url", "string"),
    field("payload", "binary"),
    field("error", "string"),
]


def _decoded(kind: str, block: bytes, digest: str | None, error: str | None) -> tuple[bytes | None, str | None]:
    if error is not None:
        return None, error
    head, gap, body = block.partition(BREAK)
    if kind == "revisit":
        return None, None
    if not gap:
        return None, "no HTTP header"
    try:
        framed = b"transfer-encoding: chunked" in head.lower()
        payload = unchunked(body) if framed else body
    except ValueError as broken:
        return None, str(broken)
    if digest is not None and digest_of(payload) != digest:
        return None, "digest differs"
    return payload, None


def _whole(table: pa.Table) -> Iterator[pa.Table]:
    """Pages of records that are given segment by segment, in order."""
    rows = zip(*(table.column(f.name).to_pylist() for f in RECORD))
    out = []
    for record, group in groupby(rows, key=lambda r: r[0]):
        parts = list(group)
        first, total = parts[0], parts[-1][3]
        block = b"".join(p[-2] for p in parts)
        whole = first[2] is None and len(parts) == 1
        if not whole and ([p[2] for p in parts] != list(range(1, len(parts) + 1)) or total is None):
            payload, error = None, "segments missing"
        elif not whole and len(block) != total:
            payload, error = None, "total length differs"
        else:
            payload, error = _decoded(first[1], block, first[5], first[-1])
        out.append((record, first[1], first[4], first[5], first[6], payload, error))
    schema = arrow_schema(PAGE)
    columns = list(zip(*out)) or [()] * len(schema)
    yield pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit with its whole decoded ``payload`` (NULL for revisits), or an ``error``.

    Only records in segments are shuffled; a group holds the segments of one record.
    """
    ship(records.sparkSession)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "block", 8_000_000):
                for made in _whole(pa.Table.from_batches([part])):
                    yield from made.to_batches()

    single = records.filter(F.col("number").isNull()).mapInArrow(alone, T.StructType(PAGE))
    parts = records.filter(F.col("number").isNotNull())
    return single.unionByName(map_runs(parts, ["record"], ["number"], PAGE, _whole, gather=16))


def page_of(record: str):
    """The page id in an identifier (``urn:page:<id>`` and, in records, a unique suffix)."""
    return F.try_element_at(F.split(F.col(record), ":"), F.lit(3)).try_cast("long")
