"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes ratios.

A feature is the presence of a character n-gram of the lower-cased text, hashed
to ``2 ** BITS`` buckets. Its value is the log ratio of the smoothed document
frequencies among toxic and other labelled texts, so a logistic regression on
these values starts from naive Bayes and corrects it. Buckets that don't tell
the classes apart (chi-squared below ``LEAST_CHI2``) are left out.

The model learns from at most ``MAX_ROWS`` labelled rows, chosen by a hash of
their id; every whole text is scored.

Defined results: a NULL or empty text has no n-gram besides those of its padding
and gets the score of the intercept, the base rate at most; repeated rows are
scored alike; NULL labels and ids and labels without a document are not learned
from; without both classes among the labels every score is the share of toxic
ones (0 without labels). A column of the input called ``score`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from condense.llm.rows import arrow_schema, field, map_texts, pieces, small_batches
from condense.session import ship, written

MAX_ROWS = 24_000
BITS = 22
ORDERS = (3, 4, 5, 6)
MAX_FEATURES = 20_000
LEAST_CHI2 = 15.0
SMOOTH = 1.0

#: Bytes of text hashed at once, which bounds the arrays of a task, and training rows per task.
PIECE_CHARS, ROWS_PER_TASK = 100_000, 2_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def buckets_of(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets at every place of the joined texts, first places and lengths of the texts."""
    padded = [" " + t.lower() + " " for t in texts]
    lengths = np.array([len(t) for t in padded], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    rolled = codes
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        rolled = rolled[:-1] * _STEP + codes[n - 1 :]
        if n in ORDERS:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _MIX
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int32), starts, lengths - n + 1


def present(texts: Sequence[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs; only buckets marked in ``wanted``."""
    found = []
    for buckets, starts, lengths in buckets_of(texts):
        places = np.arange(len(buckets)) if wanted is None else np.flatnonzero(wanted[buckets])
        text = np.searchsorted(starts, places, side="right") - 1
        inside = places - starts[text] < lengths[text]  # not reaching into the next text
        found.append((text[inside].astype(np.int64) << BITS) | buckets[places[inside]])
    keys = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    return keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weights of the buckets (ratio times coefficient), and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        wanted = np.zeros(1 << BITS, dtype=bool)
        wanted[self.buckets] = True
        values = np.zeros(1 << BITS, dtype=np.float32)
        values[self.buckets] = self.weights
        return wanted, values


def _counts(train: DataFrame) -> DataFrame:
    """Documents with each bucket: (bucket, toxic, other); one row per bucket and task before the shuffle."""
    ship(train.sparkSession)
    fields = [field("bucket", "int"), field("toxic", "long"), field("other", "long")]
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_CHARS):
                toxic = np.array(part.column("toxic").to_pylist(), dtype=np.int64)
                text, bucket = present([t or "" for t in part.column("text").to_pylist()], None)
                for c in (0, 1):
                    once, n = np.unique(bucket[toxic[text] == c], return_counts=True)
                    held[c, once] += n.astype(np.int32)
        seen = np.flatnonzero(held.any(axis=0)).astype(np.int32)
        for at in range(0, len(seen), 100_000):
            b = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b), pa.array(held[1, b].astype(np.int64)), pa.array(held[0, b].astype(np.int64))], schema=schema
            )

    found = train.select("text", "toxic").mapInArrow(run, T.StructType(fields))
    return found.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def select_features(counted: DataFrame, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that tell the classes apart, and their log-count ratios."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    c, d = toxic - a, other - b
    chi2 = (toxic + other) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d + 1e-9) * float(toxic) * other)
    ratio = F.log((a + SMOOTH) / (toxic + 2 * SMOOTH)) - F.log((b + SMOOTH) / (other + 2 * SMOOTH))
    rows = (
        counted.select("bucket", ratio.alias("ratio"), chi2.alias("chi2"))
        .filter(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.col("chi2").desc(), "bucket")
        .limit(MAX_FEATURES)
        .toPandas()
    )
    return rows["bucket"].to_numpy(dtype=np.int32), rows["ratio"].to_numpy(dtype=float)


def fit(df: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = 1e-4) -> Model:
    """Learn from ``labels`` (``doc_id``, ``toxic``) and the texts of ``df`` (``doc_id``, ``text``)."""
    small_batches(df.sparkSession)
    wanted = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_rows)
    )
    # at most max_rows small rows: a bounded broadcast, so the texts aren't shuffled
    train = df.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "toxic")
    train = written(train.repartition(max(1, max_rows // ROWS_PER_TASK)), "toxicity-train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    nothing = (np.empty(0, dtype=np.int32), np.empty(0))
    if not toxic or not other:
        share = min(max(toxic / max(1, toxic + other), 1e-9), 1 - 1e-9)
        return Model(*nothing, float(np.log(share / (1 - share))))
    buckets, ratios = select_features(_counts(train), toxic, other)
    order = np.argsort(buckets)
    buckets, ratios = buckets[order], ratios[order]
    if not len(buckets):
        return Model(*nothing, float(np.log(toxic / other)))

    def make():
        marked = np.zeros(1 << BITS, dtype=bool)
        marked[buckets] = True

        def rows(texts: list[str]):
            text, bucket = present(texts, marked)
            slots = np.searchsorted(buckets, bucket)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            return [[slots[i:j].tolist() for i, j in zip(cuts, cuts[1:])]]

        return rows

    size = len(buckets)
    vector = F.udf(lambda slots: SparseVector(size, slots, ratios[slots]), VectorUDT())
    lit = written(map_texts(train, "text", ["toxic"], [field("slots", "array_int")], make, PIECE_CHARS), "toxicity-slots")
    rows = lit.select(vector("slots").alias("features"), F.col("toxic").cast("double").alias("label"))
    learned = LogisticRegression(maxIter=60, regParam=penalty, standardization=False).fit(written(rows, "toxicity-rows"))
    return Model(buckets, ratios * learned.coefficients.toArray(), float(learned.intercept))


def score(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``score``: the probability that a text is toxic."""
    small_batches(df.sparkSession)

    def make():
        marked, values = model.table()

        def scores(texts: list[str]):
            which, bucket = present(texts, marked)
            total = np.bincount(which, weights=values[bucket], minlength=len(texts)) + model.intercept
            return [1 / (1 + np.exp(-np.clip(total, -500, 500)))]

        return scores

    return map_texts(df, text, df.columns if keep is None else keep, [field("score", "double")], make, PIECE_CHARS)
