"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Sets that are equal are
one class and are handled once. The classes are branched into trees: at every
node a few minwise positions are chosen (one, and a second with probability 1/3,
so 4/3 = 1 / threshold on average), and a document follows each chosen position to
the child named by its minwise token there. A pair of similarity s stays together
with probability s for each position. Nodes of at most ``NODE`` documents are
compared exhaustively on their sketches, larger ones branch again, and what is
still larger after ``DEPTH`` levels is compared in pairs of blocks. ``TREES``
independent trees bring the chance that a pair at the threshold is in no common
node of the last level below 0.001, and of the first below 10 ** -7.

Sketches only propose: linked proposals form candidate groups, each of which meets
in one task (or, if it is too large for one, in pairs of blocks), where links are
confirmed on the full sets. A group is searched breadth-first, so members of a
component already confirmed are not compared with each other again, and a group of
n near copies gives n - 1 links rather than all pairs.

Defined results: NULL and empty texts have an empty set, are linked with nothing and
are their own component; documents with one to four words have one shingle, the
whole sequence. Rows with the same id count as one document. A row without id is
kept, without component. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from condense.llm.components import components
from condense.llm.rows import field, map_runs, map_texts, pairs_of_blocks, runs, words_of
from condense.session import written

WORDS = 5
POSITIONS = 64
TREES = 10
DEPTH = 4
NODE = 4000

#: Least equal positions of two sketches for a proposal; a pair at the threshold has 48 on average, below 35 once in 6,000.
AGREE = 35

#: A candidate group larger than either bound is confirmed in pairs of blocks.
GROUP_SHINGLES, GROUP_ROWS = 2_000_000, 4_000

#: Words remembered per worker; only speed depends on it.
KNOWN_WORDS = 300_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROLL = np.random.default_rng(20240501)
_FLIP = _ROLL.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_SPIN = _ROLL.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) | np.uint64(1)


class _WordCodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _WordCodes()


def shingle_codes(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles of a text; A-Z count as a-z."""
    words = words_of(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(codes))
    rolled = codes[: len(codes) - width + 1] + np.uint64(width)
    for k in range(1, width):
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _M1 + codes[k : len(codes) - width + 1 + k]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * _M2
    return np.unique(rolled ^ (rolled >> np.uint64(32)))


def sketch_of(codes: np.ndarray) -> bytes:
    """The minwise token at every position, as unsigned 32-bit integers."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(codes), 4096):
        mixed = (codes[at : at + 4096, None] ^ _FLIP) * _SPIN
        np.minimum(least, mixed.min(axis=0), out=least)
    return ((least * _M1) >> np.uint64(32)).astype("<u4").tobytes()


def sketches(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(``doc``, ``n_shingles``, ``set_key``, ``sketch``) per row; the last two are NULL for an empty set."""

    def make():
        def rows(texts: list[str]):
            sets = [shingle_codes(t) for t in texts]
            return (
                [len(s) for s in sets],
                [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [sketch_of(s) if len(s) else None for s in sets],
            )

        return rows

    fields = [field("n_shingles", "long"), field("set_key", "binary"), field("sketch", "binary")]
    named = df.select(F.col(id_column).alias("doc"), F.col(text).alias("text"))
    return map_texts(named, "text", ["doc"], fields, make)


def _token(position: Column | int) -> Column:
    return F.substring(F.col("sketch"), position * 4 + 1, F.lit(4) if isinstance(position, Column) else 4)


def _roots() -> list[tuple[int, int]]:
    """(tree, position) of the positions chosen at the roots: one, and a second at every third tree."""
    order = np.random.default_rng(7).permutation(POSITIONS)
    need = [t for t in range(TREES) for _ in range(2 if t % 3 == 0 else 1)]
    return [(t, int(order[i % POSITIONS])) for i, t in enumerate(need)]


def _branch(big: DataFrame, reps: DataFrame) -> DataFrame:
    """Children of the documents in large nodes; the node's name chooses the positions."""
    joined = big.select("node", F.col("doc")).join(reps.select("doc", "sketch"), "doc")
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(POSITIONS)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(POSITIONS)).cast("int")
    twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(3)) == 0
    child = [F.xxhash64("node", p, _token(p)) for p in (first, second)]
    chosen = F.when(twice & (first != second), F.array(*child)).otherwise(F.array(child[0]))
    return joined.select("doc", F.explode(chosen).alias("node"))


def _sketch_matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u4").reshape(-1, POSITIONS)


def _links(found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


class _Left:
    """Documents of a node or group that no component has reached yet."""

    def __init__(self, sketch: np.ndarray, size: np.ndarray):
        self.at, self.sketch, self.size = np.arange(len(size)), sketch, size

    def keep(self, chosen) -> None:
        self.at, self.sketch, self.size = self.at[chosen], self.sketch[chosen], self.size[chosen]

    def near(self, sketch: np.ndarray, size: int) -> np.ndarray:
        """Which may be as similar to a document as the threshold asks."""
        low, high = np.minimum(self.size, size), np.maximum(self.size, size)
        return ((self.sketch == sketch).sum(axis=1) >= AGREE) & (100 * low >= 75 * high)


def _propose(table: pa.Table) -> Iterable[pa.Table]:
    """Sketch links of small nodes: a spanning forest of each."""
    sketch, size = _sketch_matrix(table), table.column("n_shingles").to_numpy()
    docs = table.column("doc").to_numpy()
    found: list[tuple[int, int]] = []
    for start, end in runs(table, ["node", "i", "j"]):
        left = _Left(sketch[start:end], size[start:end])
        while len(left.at) > 1:
            queue = [start + int(left.at[0])]
            left.keep(slice(1, None))
            while queue and len(left.at):
                i = queue.pop()
                hit = left.near(sketch[i], size[i])
                if hit.any():
                    reached = (start + left.at[hit]).tolist()
                    found += [(int(docs[i]), int(docs[k])) for k in reached]
                    queue += reached
                    left.keep(~hit)
    yield _links(found)


def _confirm(table: pa.Table) -> Iterable[pa.Table]:
    """Links of candidate groups that hold on the full sets: a spanning forest of each."""
    found: list[tuple[int, int]] = []
    for start, end in runs(table, ["grp", "i", "j"]):
        part = table.slice(start, end - start)
        sketch, docs = _sketch_matrix(part), part.column("doc").to_numpy()
        sets = [shingle_codes(t or "") for t in part.column("text").to_pylist()]
        size = np.array([len(s) for s in sets])
        codes, dense = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        own = [dense[e - n : e] for e, n in zip(ends, size)]
        mark = np.zeros(len(codes), dtype=bool)
        left = _Left(sketch, size)
        while len(left.at) > 1:
            queue = [int(left.at[0])]
            left.keep(slice(1, None))
            while queue and len(left.at):
                i = queue.pop()
                near = np.flatnonzero(left.near(sketch[i], size[i]))
                if not len(near):
                    continue
                others, sizes = left.at[near], left.size[near]
                mark[own[i]] = True
                hits = mark[np.concatenate([own[k] for k in others])]
                shared = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
                mark[own[i]] = False
                linked = 100 * shared >= 75 * (sizes + size[i] - shared)
                if linked.any():
                    found += [(int(docs[i]), int(docs[k])) for k in others[linked]]
                    queue += others[linked].tolist()
                    left.keep(np.delete(np.arange(len(left.at)), near[linked]))
    yield _links(found)


LINK = [field("a", "long"), field("b", "long")]


def tree_nodes(reps: DataFrame) -> DataFrame:
    """(``node``, ``doc``, ``n``): the nodes to compare, with more than one document each."""
    start = F.array(*[F.xxhash64(F.lit(t), F.lit(p), _token(p)) for t, p in _roots()])
    rows, kept = reps.select("doc", F.explode(start).alias("node")), None
    for level in range(DEPTH):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        sized = written(rows.join(sizes, "node"), "path-level")
        last = level == DEPTH - 1
        small = sized if last else sized.filter(F.col("n") <= NODE)
        kept = small if kept is None else kept.unionByName(small)
        big = sized.filter(F.col("n") > NODE)
        if last or big.isEmpty():
            break
        rows = _branch(big, reps)
    # trees find the same group again and again: equal sets of members are compared once
    members = kept.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("doc")).alias("x"),
        F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"),
    )
    once = members.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")
    return kept.join(once, "node", "left_semi")


def link_groups(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links between class representatives (``doc``, ``n_shingles``, ``sketch``)."""
    nodes = pairs_of_blocks(tree_nodes(reps), F.ceil(F.col("n") / NODE), "doc").select("node", "i", "j", "doc")
    proposed = map_runs(nodes.join(reps, "doc"), ["node", "i", "j"], ["doc"], LINK, _propose)
    groups = written(components(proposed).withColumnRenamed("component", "grp"), "path-groups")
    known = groups.join(reps, F.col("node") == F.col("doc")).select("grp", "doc", "n_shingles", "sketch")
    sizes = known.groupBy("grp").agg(
        F.ceil(F.greatest(F.sum("n_shingles") / GROUP_SHINGLES, F.count(F.lit(1)) / GROUP_ROWS)).alias("blocks")
    )
    with_text = texts.join(known, "doc")
    units = pairs_of_blocks(with_text.join(sizes, "grp"), F.col("blocks"), "doc").drop("blocks")
    return map_runs(units, ["grp", "i", "j"], ["doc"], LINK, _confirm, gather=500)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    found = written(sketches(df, id_column, text), "path-sketches")
    real = found.filter(F.col("set_key").isNotNull() & F.col("doc").isNotNull())
    classes = written(
        real.groupBy("set_key").agg(F.min(F.struct("doc", "n_shingles", "sketch")).alias("first")), "path-classes"
    )
    reps = classes.select("first.*")
    texts = df.select(F.col(id_column).alias("doc"), F.col(text).alias("text"))
    links = link_groups(reps, texts)
    # rows with one id but different texts are one document: their classes belong together
    own = real.select("doc", "set_key").join(classes.select("set_key", F.col("first.doc").alias("rep")), "set_key")
    joined = components(links.unionByName(own.filter(F.col("doc") != F.col("rep")).select(F.col("doc").alias("a"), F.col("rep").alias("b"))))
    joined = joined.select(F.col("node").alias("doc"), F.col("component").alias("component_id"))
    out = found.join(joined, "doc", "left").withColumn("component_id", F.coalesce("component_id", "doc"))
    return out.select(
        F.col("doc").alias(id_column),
        "n_shingles",
        "component_id",
        (F.col("component_id").isNull() | (F.col("component_id") == F.col("doc"))).alias("kept"),
    )
