"""Quality scores: random-indexing word vectors pooled per document, and a small network with calibrated probabilities.

*Random indexing.* A token (a run of letters and digits, or of other marks) falls into
one of ``2 ** BITS`` buckets. Each bucket has a sparse index vector of ``NONZERO`` signs
among ``DIMS`` places, drawn from its number. The context vector of a bucket is the sum of
the index vectors of all tokens within ``WINDOW`` places, over the whole corpus: each task adds
up a table of fixed size, and the tables are summed by bucket. So the vectors rest on every
document, and what leaves a task, is collected and is sent to the tasks has a bound that is no matter of
the data.

*Pooling.* A document is the mean and the spread of its tokens' unit vectors, how alike neighbouring and next
but one tokens are, and its length.

*Network.* One hidden layer of ``HIDDEN`` units, trained with numpy on at most ``MAX_ROWS``
labelled documents; a fifth of them, by hash of the id, only sets the temperature by which the
output is divided, so that scores are probabilities.

Defined results: a NULL or empty text has no token and the score of a document whose features are
all zero; repeated rows are scored alike; NULL labels and ids and labels without a document
are not learned from; if many rows share a labelled id, the bound holds for rows; without both classes among the
labels every score is the share of good ones (0 without labels); an empty table gives an empty
one. Very long texts are read whole, ``BLOCK`` tokens at a time. A kept column called ``pooled`` or
``score`` gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from condense.llm.rows import arrow_schema, field, map_texts, pieces
from condense.session import ship, written

BITS, DIMS, NONZERO, WINDOW = 15, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
MAX_ROWS = 20_000
SEED = 11

#: Tokens taken from a text at once, tokens remembered with their bucket, characters of texts pooled at once.
BLOCK, REMEMBERED, PIECE_CHARS = 200_000, 400_000, 500_000

FEATURES = 2 * DIMS + 3

#: Stands between texts.
NOTHING = 1 << BITS

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """Token -> bucket; computed once per token and task."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = crc32(token.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        return found


def blocks_of(text: str, buckets: Buckets) -> Iterator[np.ndarray]:
    """Buckets of the tokens of a text, in order, at most ``BLOCK`` at a time."""
    if len(text) <= BLOCK:
        tokens = _TOKEN.findall(text)
        if tokens:
            yield np.fromiter(map(buckets.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return
    found = _TOKEN.finditer(text)
    while some := [m.group() for m in islice(found, BLOCK)]:
        yield np.fromiter(map(buckets.__getitem__, some), dtype=np.int64, count=len(some))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each bucket, and of none (the last row) between texts."""
    dice = np.random.default_rng(SEED)
    places = dice.permuted(np.tile(np.arange(DIMS), (1 << BITS, 1)), axis=1)[:, :NONZERO]
    signs = dice.choice(np.array([-1, 1], dtype=np.int64), size=places.shape)
    return np.vstack([places, np.zeros((1, NONZERO), dtype=places.dtype)]), np.vstack([signs, np.zeros((1, NONZERO), dtype=np.int64)])


class Contexts:
    """Context sums of all buckets, and how many contexts each has had."""

    def __init__(self) -> None:
        self.places, self.signs = index_vectors()
        self.sums = np.zeros(((1 << BITS) + 1) * DIMS, dtype=np.int64)
        self.seen = np.zeros((1 << BITS) + 1, dtype=np.int64)

    def add(self, tokens: np.ndarray, known: int = 0) -> None:
        """Take in a run of tokens, the first ``known`` of which have met each other; ``NOTHING`` is a gap."""
        for apart in range(1, WINDOW + 1):
            start = max(known, apart)
            left, right = tokens[start - apart : len(tokens) - apart], tokens[start:]
            for word, other in ((left, right), (right, left)):
                self.seen += np.bincount(word[other != NOTHING], minlength=len(self.seen))
                for k in range(NONZERO):
                    np.add.at(self.sums, word * DIMS + self.places[other, k], self.signs[other, k])


def context_sums(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context sums and counts of the buckets over all texts: a table of ``2 ** BITS`` rows."""
    ship(df.sparkSession)
    names = [f"d{i}" for i in range(DIMS)]
    fields = [field("bucket", "long"), field("seen", "long"), *[field(n, "long") for n in names]]
    schema = arrow_schema(fields)
    gap = np.full(WINDOW, NOTHING, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, buckets = Contexts(), Buckets()
        held, size, known = [], 0, 0
        for batch in batches:
            for part in pieces(batch, "text"):
                for value in part.column("text").to_pylist():
                    for block in (*blocks_of(value or "", buckets), gap):
                        held.append(block)
                        size += len(block)
                        if size > BLOCK:
                            joined = np.concatenate(held)
                            contexts.add(joined, known)
                            held = [joined[-WINDOW:]]
                            size = known = len(held[0])
        if held:
            contexts.add(np.concatenate(held), known)
        seen = np.flatnonzero(contexts.seen[:NOTHING])
        table = contexts.sums.reshape(-1, DIMS)[seen]
        for at in range(0, len(seen), 10_000):
            rows = slice(at, at + 10_000)
            columns = [seen[rows], contexts.seen[seen[rows]], *[np.ascontiguousarray(table[rows, i]) for i in range(DIMS)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    found = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, T.StructType(fields))
    rows = found.groupBy("bucket").agg(F.sum("seen").alias("seen"), *[F.sum(n).alias(n) for n in names]).toPandas()
    sums, seen = np.zeros((NOTHING, DIMS), dtype=np.int64), np.zeros(NOTHING, dtype=np.int64)
    at = rows["bucket"].to_numpy(dtype=np.int64)
    sums[at], seen[at] = rows[names].to_numpy(dtype=np.int64), rows["seen"].to_numpy(dtype=np.int64)
    return sums, seen


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """A unit vector per bucket: its mean context less that of all tokens; zero for a bucket without contexts."""
    sums, seen = context_sums(df, text)
    mean = sums / np.maximum(seen, 1)[:, None]
    away = np.where(seen[:, None] > 0, mean - sums.sum(axis=0) / max(1, seen.sum()), 0.0)
    length = np.linalg.norm(away, axis=1, keepdims=True)
    return (away / np.where(length > 0, length, 1.0)).astype(np.float32)


def pooled_features(texts: Sequence[str], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; neighbours are compared inside a block."""
    total = np.zeros((len(texts), 2 * DIMS + 2))
    n = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owners: list[int] = []

    def fold() -> None:
        lengths = np.array([len(b) for b in held])
        found = vectors[np.concatenate(held)]
        starts = np.cumsum(lengths) - lengths
        whose, block = np.array(owners), np.repeat(np.arange(len(held)), lengths)
        np.add.at(total[:, :DIMS], whose, np.add.reduceat(found, starts, axis=0, dtype=np.float64))
        np.add.at(total[:, DIMS : 2 * DIMS], whose, np.add.reduceat(found * found, starts, axis=0, dtype=np.float64))
        for apart in (1, 2):
            alike = np.einsum("ij,ij->i", found[:-apart], found[apart:], dtype=np.float64) * (block[:-apart] == block[apart:])
            total[:, 2 * DIMS + apart - 1] += np.bincount(whose[block[apart:]], weights=alike, minlength=len(texts))
        np.add.at(n, whose, lengths)
        held.clear()
        owners.clear()

    size = 0
    for i, text in enumerate(texts):
        for block in blocks_of(text, buckets):
            held.append(block)
            owners.append(i)
            size += len(block)
            if size > BLOCK:
                fold()
                size = 0
    if held:
        fold()
    share = total / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(share[:, DIMS : 2 * DIMS] - share[:, :DIMS] ** 2, 0))
    return np.hstack([share[:, :DIMS], spread, share[:, 2 * DIMS :], np.log1p(n)[:, None]])


def pool(df: DataFrame, vectors: np.ndarray, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``pooled``, the features of the text."""

    def make():
        buckets = Buckets()
        return lambda texts: [pooled_features(texts, vectors, buckets).tolist()]

    return map_texts(df, text, df.columns if keep is None else keep, [field("pooled", "array_double")], make, PIECE_CHARS)


@dataclass(frozen=True)
class Network:
    """Standardisation, two layers and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of a good text, not yet calibrated."""
        return np.tanh((rows - self.centre) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows) / self.temperature, -500, 500)))


def constant(share: float) -> Network:
    """A network that gives every text the same probability."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    none = np.zeros((FEATURES, 1))
    return Network(np.zeros(FEATURES), np.ones(FEATURES), none, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train_network(rows: np.ndarray, good: np.ndarray) -> Network:
    """Two layers by Adam on the log loss."""
    dice = np.random.default_rng(SEED)
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x, y = (rows - centre) / scale, good.astype(float)
    weights = [dice.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    weights[2] = dice.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = dice.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            inner = np.tanh(x[part] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -500, 500)))
            off = (p - y[part]) / len(part)
            back = np.outer(off, weights[2]) * (1 - inner**2)
            slopes = [x[part].T @ back + DECAY * weights[0], back.sum(axis=0), inner.T @ off + DECAY * weights[2], off.sum(keepdims=True)]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]))


def temperature(margin: np.ndarray, good: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the network hasn't learned from."""
    tried = np.geomspace(0.25, 8.0, 141)
    side = np.where(good, -margin, margin)
    loss = [float(np.logaddexp(0, side / t).mean()) for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(pooled: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """Learn from ``labels`` (``doc_id``, ``quality``) and the features of ``pooled`` (``doc_id``, ``pooled``)."""
    dice = F.xxhash64("doc_id", F.lit(SEED))
    wanted = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("int").alias("_quality"))
        .orderBy(dice, "doc_id", "_quality")
        .limit(max_rows)
    )
    # at most max_rows ids; of rows that share an id no more than that many are taken either
    rows = pooled.select("doc_id", "pooled").join(F.broadcast(wanted), "doc_id")
    rows = rows.select(dice.alias("dice"), "doc_id", "pooled", "_quality").orderBy("dice", "doc_id", "_quality", "pooled").limit(max_rows)
    got = rows.toPandas()
    good = (got["_quality"] == 1).to_numpy()
    if not good.any() or good.all():
        return constant(float(good.mean()) if len(good) else 0.0)
    x = np.array(got["pooled"].tolist(), dtype=float)
    aside = got["dice"].to_numpy() % 5 == 0
    if not (good[~aside].any() and not good[~aside].all()):
        aside[:] = False
    network = train_network(x[~aside], good[~aside])
    if not aside.any():
        return network
    return Network(**network.__dict__ | {"temperature": temperature(network.margin(x[aside]), good[aside])})


def score(pooled: DataFrame, network: Network, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``pooled`` by default) and ``score``: the probability that a text is good."""
    ship(pooled.sparkSession)
    keep = [c for c in (pooled.columns if keep is None else keep) if c not in ("pooled", "score")]
    fields = [pooled.schema[c] for c in keep] + [field("score", "double")]
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keep))
            rows = values.flatten().to_numpy().reshape(len(values), FEATURES)
            kept = [batch.column(i).cast(schema.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(network.probability(rows))], schema=schema)

    chosen = pooled.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("pooled").alias("_pooled"))
    return chosen.mapInArrow(run, T.StructType(fields))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) of ``df`` (``doc_id``, text) and ``score``, learned from ``labels``."""
    keep = list(df.columns if keep is None else keep)
    if "doc_id" in keep:
        pooled = written(pool(df, word_vectors(df, text), text, keep), "pooled")
        return score(pooled, fit(pooled, labels), keep)
    raise ValueError("the documents are matched with their labels by doc_id, which has to be kept")
