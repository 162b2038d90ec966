"""Best-fit packing of token runs into sequences of a fixed length, in bulk-synchronous rounds.

Documents are range-sorted by size, largest first, over as many partitions as they
need, and numbered within their size; for the numbers only one count per partition
and size travels. Documents of one size are interchangeable and so are gaps (what
open sequences have left) of one size, so the rounds work on ranges of numbers and
cost the same for any number of rows. A round sweeps once through all sizes: gaps that
have been passed wait on a stack, and a document takes the gap passed last, the
smallest that holds it; where several want the same, the lower number has it. All
matches of a round are made before any gap shrinks. Then gaps are updated and the next
round starts. When nothing fits, the largest documents open new sequences. In the end
every partition looks its documents' numbers up in the matched ranges.

Documents longer than a sequence are cut from their end into full pieces, so only
the first piece is shorter; full pieces are sequences of their own.

Defined results: a NULL or empty text is a document of the end token alone;
repeated rows are documents of their own; an empty table gives no rows; other
columns are carried only if named in ``keep``, those with the name of a result give way.
Ties in size are ordered by row. A very long text is encoded whole and cut into
as many pieces as it needs; one with a run of more than ``BLANKS`` blanks goes through the
encoder of ``bpe``, since the expression of tiktoken can't get through such a run.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from condense.llm.bpe import PATTERN, byte_of_char, read_vocabulary, vocabulary
from condense.llm.rows import arrow_schema, field, pieces
from condense.session import ship, written

ROWS_PER_TASK = 100_000

BLANKS = 2_000
_LONG_BLANK = re.compile(r"\s{%d}" % BLANKS)

PIECE = [
    field("piece", "int"),
    field("start", "long"),
    field("length", "long"),
    field("ids_crc32", "long"),
    field("_key", "long"),
]


@lru_cache(maxsize=2)
def _encoding(source: str) -> tiktoken.Encoding:
    """The vocabulary of a ``tokenizers`` file in the encoder of tiktoken, which gives the same ids."""
    said, back = json.loads(source), byte_of_char()
    ranks = {bytes(back[c] for c in token): i for token, i in said["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
    ranks = {token: i for token, i in ranks.items() if i not in added.values()}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def ids_of(text: str, source: str) -> np.ndarray:
    """Ids of a text in the vocabulary of ``source``."""
    if len(text) >= BLANKS and _LONG_BLANK.search(text):
        return np.frombuffer(vocabulary(source).encode(text), dtype="<u4")
    return np.array(_encoding(source).encode(text, allowed_special="all"), dtype="<u4")


def token_pieces(df: DataFrame, path: str, limit: int, end_id: int, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per piece with the checksum of its ids."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    keep = [c for c in keep if c not in {f.name for f in PIECE + PLACE}]
    fields = [df.schema[c] for c in keep] + PIECE
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in pieces(batch, "__text"):
                made: list[tuple] = []
                source: list[int] = []
                for row, value in enumerate(part.column("__text").to_pylist()):
                    ids = np.append(ids_of(value or "", sent.value), np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % limit + 1
                    for n, start in enumerate([0, *range(first, len(ids), limit)]):
                        end = first if n == 0 else start + limit
                        made.append((n, start, end - start, zlib.crc32(ids[start:end].tobytes()), key))
                        source.append(row)
                        key += 1
                kept = [part.column(f"__k{i}").take(pa.array(source)).cast(schema[i].type) for i in range(len(keep))]
                new = [pa.array(c, type=schema.field(f.name).type) for f, c in zip(PIECE, zip(*made))]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema=schema)

    chosen = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("__text"))
    return chosen.mapInArrow(run, T.StructType(fields))


PLACE = [field("sequence_id", "long"), field("offset", "long")]
RESULTS = [f.name for f in PIECE[:-1] + PLACE]
NUMBER = [field("_part", "int"), field("_number", "long")]


def numbered(items: DataFrame, rows: int) -> DataFrame:
    """Range-sort by ``length``, largest first; add the partition and the number within partition and length."""
    ship(items.sparkSession)
    schema = T.StructType([*items.schema.fields, *NUMBER])
    arrow = arrow_schema(schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            places = np.arange(len(lengths))
            starts = np.flatnonzero(np.diff(lengths, prepend=size))
            since = np.zeros(len(lengths), dtype=np.int64)
            since[starts] = starts
            numbers = places - np.maximum.accumulate(since)
            numbers[: starts[0] if len(starts) else len(lengths)] += seen  # goes on from the batch before
            size, seen = int(lengths[-1]), int(numbers[-1]) + 1
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow)]
            where = pa.array(np.full(len(lengths), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*columns, where, pa.array(numbers)], schema=arrow)

    order = [F.col("length").desc(), F.col("_key").asc()]
    dealt = items.repartitionByRange(max(1, math.ceil(rows / ROWS_PER_TASK)), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


Match = tuple[int, int, int, int, int]  # length, first number, count, first sequence, offset


def _sweep(counts: dict[int, int], given: dict[int, int], gaps: list[tuple[int, int, int]], limit: int):
    """One round: matches, and the gaps (size, first sequence, count) after it. ``given`` counts what has a place."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for size, first, n in gaps:
        by_size.setdefault(size, []).append((first, n))
    stack: list[list[int]] = []
    made: list[Match] = []
    after: list[tuple[int, int, int]] = []
    for size in sorted({*by_size, *(s for s, n in counts.items() if n > given.get(s, 0))}, reverse=True):
        stack += [[size, first, n] for first, n in by_size.get(size, [])]
        while stack and counts.get(size, 0) > given.get(size, 0):
            gap, first, free = stack[-1]
            n = min(free, counts[size] - given.get(size, 0))
            made.append((size, given.get(size, 0), n, first, limit - gap))
            given[size] = given.get(size, 0) + n
            after.append((gap - size, first, n))
            if n == free:
                stack.pop()
            else:
                stack[-1][1:] = [first + n, free - n]
    return made, after + [tuple(run) for run in stack]


def plan(counts: dict[int, int], limit: int) -> list[Match]:
    """Matches that give every document of ``counts`` (length to number of documents) its place."""
    given: dict[int, int] = {}
    gaps: list[tuple[int, int, int]] = []
    made: list[Match] = []
    opened = 0
    waiting = sum(counts.values())
    tokens = sum(s * n for s, n in counts.items())
    todo = max(sum(n for s, n in counts.items() if 2 * s > limit), math.ceil(tokens / limit))  # no packing has fewer
    while waiting:
        for size in sorted(counts, reverse=True):  # the largest documents open sequences
            n = min(todo, counts[size] - given.get(size, 0))
            if n > 0:
                made.append((size, given.get(size, 0), n, opened, 0))
                gaps.append((limit - size, opened, n))
                given[size] = given.get(size, 0) + n
                opened, todo, waiting = opened + n, todo - n, waiting - n
        while waiting:
            least = min(s for s, n in counts.items() if n > given.get(s, 0))
            found, gaps = _sweep(counts, given, [g for g in gaps if g[0] >= least], limit)
            made += found
            waiting -= sum(m[2] for m in found)
            if not found:
                break
        left = sum(s * (n - given.get(s, 0)) for s, n in counts.items())
        todo = math.ceil(left / limit)
    return made


def placed(items: DataFrame, rows: int, limit: int) -> DataFrame:
    """``items`` (``length`` < ``limit``, ``_key``) with their sequence and offset."""
    spark = items.sparkSession
    listed = written(numbered(items, rows), "packing-numbers")
    # one row per length, and one more for each further partition that a length reaches into
    parts = listed.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, int] = {}
    ahead: dict[tuple[int, int], int] = {}
    for part, length, n in sorted(tuple(r) for r in parts):
        ahead[part, length] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    matches = np.array(sorted(plan(counts, limit)), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((ahead, matches))
    keep = [f for f in items.schema.fields if f.name != "_key"]
    schema = T.StructType([*keep, *PLACE])
    arrow = arrow_schema(schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ranges = sent.value
        starts = ranges[:, 0] * (1 << 44) + ranges[:, 1]
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            base = [before[k] for k in zip(batch.column("_part").to_pylist(), lengths.tolist())]
            number = batch.column("_number").to_numpy() + np.array(base, dtype=np.int64)
            at = np.searchsorted(starts, lengths * (1 << 44) + number, side="right") - 1
            sequence = ranges[at, 3] + number - ranges[at, 1]
            columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(ranges[at, 4])], schema=arrow)

    return listed.mapInArrow(run, schema)


def pack(
    df: DataFrame, path: str, limit: int = 2048, end_id: int = 0, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset`` in sequences of at most ``limit`` tokens."""
    keep = [c for c in keep if c not in RESULTS]
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    given = df.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{text}`").alias("_text"))
    cut = written(token_pieces(given, path, limit, end_id, "_text", list(names)), "packing-pieces")
    full = F.col("length") == limit
    alone = cut.filter(full).withColumns({"sequence_id": F.lit(-1) - F.col("_key"), "offset": F.lit(0).cast("long")})
    items = cut.filter(~full)
    both = alone.drop("_key").unionByName(placed(items, items.count(), limit))
    return both.select(*[F.col(k).alias(c) for k, c in names.items()], *RESULTS)
