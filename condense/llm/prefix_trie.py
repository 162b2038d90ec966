"""The trie of shared conversation prefixes, by range-minimum queries over sorted conversations.

A conversation is a path of turn digests, 16 bytes a turn. All paths are sorted by
a range exchange, so conversations that share their first turns stand side by side and
the members of a trie node are an interval. A task walks its range in chunks of bounded
size. In a chunk, the lengths of the common prefixes of neighbours (LCP) go into a sparse
table of minima; every candidate prefix then searches the ends of its interval on its own,
left and right, by halving steps over the table, all candidates at once. Running sums over
the sorted rows give members, leaves, children and saved characters of any interval as
differences, so no stack and no walk over the trie is needed.

Nodes inside a chunk are finished there. Only prefixes of a chunk's first or last row can
reach beyond it; they leave the chunk as partial counts and are added up by their digest, one
row per chunk even for the root. Where two chunks meet, what they counted apart
(a shared child, a leaf that goes on, turns saved between the two rows) is put right by a row
per shared prefix. A task knows its own seams; the first and last rows of the tasks' ranges, as many as the exchange has
partitions, are compared in one place.

The hash of a node's ends covers all their numbers in order, so it is one stream by its
definition: numbers travel as joined pieces of up to ``PIECE_IDS`` and one task feeds
them to the hash, holding a piece at a time.

Defined results: a NULL role or text is an empty string; turns are ordered by number
(NULL first), those of one number by the digest of role and text; repeated rows are turns of their own; rows without
a conversation id belong to no conversation and are not read; a conversation is the unit
that has to fit a task (some 50 bytes a turn, its texts don't travel); an empty table
has no root and gives no node; columns besides the four are not read. Repeated conversations
share all their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from condense.llm.rows import arrow_schema, field
from condense.session import ship, written

WIDTH = 16

#: Conversations and turns of a chunk, which bound the arrays of a task, and numbers in one piece of ends.
CHUNK_ROWS, CHUNK_TURNS, PIECE_IDS = 20_000, 200_000, 256


def conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(``conv_id``, ``turns``): per conversation its ordered turns as structs of ``digest`` (hex) and ``chars``."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 2 * WIDTH)
    number = F.col(turn)
    one = F.struct(
        number.isNotNull().alias("numbered"),
        F.coalesce(number.cast("long"), F.lit(0)).alias("turn"),
        digest.alias("digest"),
        F.length(said).cast("long").alias("chars"),
    )
    named = df.where(F.col(conversation).isNotNull()).select(F.col(conversation).cast("long").alias("conv_id"), one.alias("one"))
    return named.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("one")), lambda t: F.struct(t["digest"], t["chars"])).alias("turns")
    )


def graft(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation with its first ``head`` turns (at most ``most``) taken from conversation ``base``.

    A base is its own base; where it is missing, nothing stands for the first turns.
    """
    own_type = convs.schema["turns"].dataType
    heads = convs.where(F.col("conv_id") == base).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    joined = convs.select("*", base.alias("_base"), head.cast("int").alias("_h")).join(heads, "_base", "left")
    front = F.slice(F.coalesce("_head", F.array().cast(own_type)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(front, rest).alias("turns"))


class Chunk:
    """Sorted paths of a chunk with their common prefixes, running sums and range minima."""

    def __init__(self, ids: np.ndarray, paths: Sequence[bytes], chars: Sequence[np.ndarray]):
        n = len(ids)
        self.ids, self.paths, self.n = ids, paths, n
        self.depth = np.fromiter((len(p) // WIDTH for p in paths), dtype=np.int64, count=n)
        starts = np.cumsum(self.depth) - self.depth
        self.flat = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
        sums = np.concatenate([[0], np.cumsum(np.concatenate(chars) if n else np.empty(0, dtype=np.int64))])
        self.starts, self.sums = starts, sums
        self.lcp = self._common()
        # the row a new prefix starts with counts from its own interval: before the first row nothing is shared
        shared = np.maximum(self.lcp, 0)
        self.saved = np.concatenate([[0], np.cumsum(self.chars_to(np.arange(n), shared))])
        after = np.append(self.lcp[1:], -1)
        self.leaves = np.concatenate([[0], np.cumsum(after < self.depth)])
        self.table = [self.lcp]
        while 2 << (len(self.table) - 1) <= n:
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def chars_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Characters of the first ``depth`` turns of ``row``."""
        return self.sums[self.starts[row] + depth] - self.sums[self.starts[row]]

    def _common(self) -> np.ndarray:
        """Turns that each row shares with the one before it; -1 for the first row."""
        lcp = np.full(self.n, -1, dtype=np.int64)
        lcp[1:] = 0
        open_ = np.arange(1, self.n)
        at = 0
        while len(open_):
            open_ = open_[(self.depth[open_] > at) & (self.depth[open_ - 1] > at)]
            same = (self.flat[self.starts[open_] + at] == self.flat[self.starts[open_ - 1] + at]).all(axis=1)
            open_ = open_[same]
            at += 1
            lcp[open_] = at
        return lcp

    def extents(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row that share the first ``depth`` turns of ``row``, searched for each on its own."""
        left, right = row.copy(), row.copy()
        for k in range(len(self.table) - 1, -1, -1):
            low, step = self.table[k], 1 << k
            # 2**k values of the LCP right of the interval, then left of it, are large enough
            fits = right + step < self.n
            fits[fits] = low[right[fits] + 1] >= depth[fits]
            right += fits * step
            fits = left - step >= 0
            fits[fits] = low[left[fits] - step + 1] >= depth[fits]
            left -= fits * step
        return left, right

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, depth) of every prefix, once: the first row that has it."""
        new = self.depth - self.lcp
        row = np.repeat(np.arange(self.n), new)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + self.lcp[row] + 1

    def least_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Smallest id of each interval, by range minima over the ids."""
        table = [self.ids]
        while 2 << (len(table) - 1) <= self.n:
            low, half = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(low[:-half], low[half:]))
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), dtype=np.int64)
        for k, low in enumerate(table):
            at = level == k
            out[at] = np.minimum(low[left[at]], low[right[at] - (1 << k) + 1])
        return out


def prefix_digests(path: bytes) -> list[bytes]:
    """A digest for every prefix of a path, the empty one first."""
    state, out = hashlib.sha256(), []
    for at in range(0, len(path) + 1, WIDTH):
        out.append(state.digest()[:WIDTH])
        state.update(path[at : at + WIDTH])
    return out


#: What a task gives out, by kind: finished nodes, shares of nodes on borders (and corrections of them), pieces of
#: their ends, first and last row of its range.
NODE, SHARE, ENDS, EDGE = 0, 1, 2, 3
_OUT = [
    field("kind", "int"), field("part", "int"), field("chunk", "long"), field("node", "binary"), field("parent", "binary"),
    field("conv_id", "long"), field("depth", "long"), field("parent_conv_id", "long"), field("n_convs", "long"),
    field("n_children", "long"), field("n_leaves", "long"), field("saved", "long"), field("ends", "string"),
    field("path", "binary"), field("chars", "array_long"),
]
_ADDED = ("n_convs", "n_children", "n_leaves", "saved")
_HOME = ("part", "chunk")


def seam(before: bytes, after: bytes, chars: Sequence[int]) -> list[dict]:
    """Corrections of every prefix that the last row of a chunk shares with the first of the next.

    ``chars`` are the characters of the turns of the row ``after``.
    """
    common = 0
    for at in range(0, min(len(before), len(after)), WIDTH):
        if before[at : at + WIDTH] != after[at : at + WIDTH]:
            break
        common += 1
    to = [0, *np.cumsum(np.asarray(chars[:common], dtype=np.int64)).tolist()]
    goes_on = common * WIDTH == len(before)
    return [
        {
            "kind": SHARE,
            "node": node,
            "depth": depth,
            "n_convs": 0,
            "n_children": -int(common > depth),  # both counted the child they share
            "n_leaves": -int(goes_on),  # the row before seemed to end there, but goes on or is repeated
            "saved": to[common] - to[max(depth - 1, 0)],
        }
        for depth, node in enumerate(prefix_digests(after[: common * WIDTH]))
    ]


def nodes_of(chunk: Chunk, part: int, number: int) -> Iterator[dict]:
    """The nodes of a chunk: finished ones, and the chunk's share of those that reach its border."""
    row, depth = chunk.candidates()
    left, right = chunk.extents(row, depth)
    least = chunk.least_ids(left, right)
    saved = chunk.saved[right + 1] - chunk.saved[left + 1] - (right - left) * chunk.chars_to(row, np.maximum(depth - 1, 0))
    leaves = chunk.leaves[right + 1] - chunk.leaves[left]
    border = (left == 0) | (right == chunk.n - 1)

    # the parent is the candidate before in the same row; that of a row's first candidate is in the row its interval begins with
    new = chunk.depth - chunk.lcp
    place = np.cumsum(new) - new
    parent = np.arange(len(row)) - 1
    first = place[(new > 0) & (chunk.lcp >= 0)]
    home, _ = chunk.extents(row[first], depth[first] - 1)
    parent[first] = place[home] + depth[first] - chunk.lcp[home] - 2
    children = np.bincount(parent[parent >= 0], minlength=len(row))

    # rows that end at a node are the equal paths its interval begins with
    again = np.zeros(chunk.n, dtype=bool)
    again[1:] = (chunk.lcp[1:] == chunk.depth[1:]) & (chunk.depth[1:] == chunk.depth[:-1])
    begins = np.flatnonzero(~again)
    equal = np.zeros(chunk.n, dtype=np.int64)
    equal[begins] = np.diff(np.append(begins, chunk.n))
    ended = np.where(chunk.depth[left] == depth, equal[left], 0)

    names: list[bytes] = []
    for i in np.flatnonzero(new > 0).tolist():
        names += prefix_digests(chunk.paths[i])[chunk.lcp[i] + 1 :]
    columns = (left, right, depth, least, saved, leaves, border, parent, children, ended)
    for node, (l, r, d, smallest, chars, n_leaves, open_, up, n_children, e) in zip(names, zip(*(c.tolist() for c in columns))):
        ids = chunk.ids[l : l + e].tolist()
        made = {
            "kind": SHARE if open_ else NODE, "part": part, "chunk": number, "node": node,
            "parent": names[up] if up >= 0 else None, "conv_id": smallest, "depth": d,
            "parent_conv_id": int(least[up]) if up >= 0 and not border[up] else None,
            "n_convs": r - l + 1, "n_children": n_children, "n_leaves": n_leaves, "saved": chars,
        }
        if open_:
            yield made
            for at in range(0, e, PIECE_IDS):
                some = ids[at : at + PIECE_IDS]
                yield {"kind": ENDS, "node": node, "conv_id": some[0], "ends": ",".join(map(str, some))}
        else:
            yield made | {"ends": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}


def _walk(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """All chunks of a task's range, in order, with the seams between them."""
    schema = arrow_schema(_OUT)
    part = TaskContext.get().partitionId()
    ids: list[int] = []
    paths: list[bytes] = []
    chars: list[np.ndarray] = []
    first = last = None
    turns = number = 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal first, last
        rows = [] if last is None else seam(last, paths[0], chars[0])
        if first is None:
            first = {"kind": EDGE, "part": part, "chunk": 0, "path": paths[0], "chars": chars[0].tolist()}
        last = paths[-1]
        rows += nodes_of(Chunk(np.array(ids, dtype=np.int64), paths, chars), part, number)
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=schema)

    for batch in batches:
        lists = batch.column("chars")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, (conv, path) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist())):
            ids.append(conv)
            paths.append(path)
            chars.append(values[offsets[i] : offsets[i + 1]])
            turns += len(chars[-1])
            if len(ids) >= chunk_rows or turns >= CHUNK_TURNS:
                yield from close()
                ids, paths, chars, turns, number = [], [], [], 0, number + 1
    if ids:
        yield from close()
    if first is not None:
        yield pa.RecordBatch.from_pylist([first, {"kind": EDGE, "part": part, "chunk": 1, "path": last}], schema=schema)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_OUT)
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            yield pa.RecordBatch.from_pylist(seam(r["before"], r["path"], r["chars"]), schema=schema)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its sorted pieces; a piece at a time is held."""
    schema = arrow_schema([field("node", "binary"), field("hash", "string")])
    node, state = None, hashlib.sha256()

    def out(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], type=schema.field(i).type) for i in (0, 1)], schema=schema)

    for batch in batches:
        done = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            state.update(ids.encode())
        yield out(done)
    if node is not None:
        yield out([(node, state.hexdigest())])


def trie(convs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every node of the trie over ``convs`` (``conv_id``, ``turns`` as of ``conversations``).

    Gives ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (characters said more than once in the subtree) and ``ends_sha256``.
    """
    ship(convs.sparkSession)
    schema = T.StructType(_OUT)
    rows = convs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    dealt = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = written(dealt.mapInArrow(lambda batches: _walk(batches, chunk_rows), schema), "trie")

    # two rows per partition of the exchange: the last row of a range meets the first of the next
    edges = made.where(F.col("kind") == EDGE)
    met = edges.select("chunk", "path", "chars", F.lag("path").over(W.orderBy(*_HOME)).alias("before"))
    seams = met.where((F.col("chunk") == 0) & F.col("before").isNotNull()).mapInArrow(_seams, schema)

    shares = made.where(F.col("kind") == SHARE)
    border = shares.unionByName(seams).groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in _ADDED],
    )
    border = written(border, "trie-borders")
    pieces = made.where(F.col("kind") == ENDS).select("node", "conv_id", "ends")
    hashed = pieces.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_ends, "node binary, hash string")
    smallest = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("_up"))
    nothing = hashlib.sha256().hexdigest()
    whole = border.join(hashed, "node", "left").join(smallest, "parent", "left")
    whole = whole.select("conv_id", "depth", F.col("_up").alias("parent_conv_id"), *_ADDED, F.coalesce("hash", F.lit(nothing)).alias("ends"))

    # a finished node under one on the border finds it among the few of its own chunk, so no parent is a hot key
    near = shares.where(F.col("part").isNotNull()).select(*_HOME, F.col("node").alias("parent")).join(smallest, "parent")
    inner = made.where(F.col("kind") == NODE).join(near, [*_HOME, "parent"], "left")
    inner = inner.select("conv_id", "depth", F.coalesce("parent_conv_id", "_up").alias("parent_conv_id"), *_ADDED, "ends")
    return inner.unionByName(whole).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
