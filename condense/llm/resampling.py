"""Importance resampling: draw the documents that look most like a target corpus.

Features are runs of 1 to ``orders`` consecutive words, each counted in the bucket
that its CRC-32 falls into. One pass counts the buckets of the source and of the
target; the gain of a bucket is the scaled log of its smoothed frequency in the target
over that in the source. A second pass gives each document the mean gain of its
features, and the highest of these weights plus Gumbel noise are drawn, which is
sampling without replacement in proportion to the weights.

Words come from bytes: a table of 256 entries lower-cases A-Z and turns every ASCII
character besides letters and digits into a blank, in UTF-8 text without decoding it,
and ``bytes.split`` cuts there. The CRC of a run is the one of the run without its last
word, carried on over a blank and that word, so longer runs cost one short call each.
A ``Counter`` per task reduces the hashes before anything is shuffled; what reaches the
driver is one number per bucket, and a histogram of whole-number scores.

Ranks are made by a range sort: every partition numbers its rows and the sizes of the
partitions before it are added, so no task sees more than its share. Equal rows
are told apart by a number of their own, so any number of them is spread, too.

Defined results: a NULL or empty text, or one without words, has no feature and weight 0;
so has every text if the target has no features besides the smoothing; a NULL id is
drawn with the noise of an empty one and sorts after the others; repeated rows are
rows of their own; an empty table gives an empty one. Very long texts are read whole, one at
a time. Kept columns that have the name of a result (``n_features``, ``weight``,
``score``, ``rank``) give way to it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from condense.llm.rows import arrow_schema, field, map_texts, pieces
from condense.session import ship, written

BUCKETS = 10_000
ORDERS = 2
LEAST_WORDS = 20
SHARE = 25
SEED = 7

#: Hashes held by a task's counter before they are folded into its buckets.
HELD = 1_000_000

RESULTS = ("n_features", "weight", "score", "rank")


def _byte_table() -> bytes:
    """Letters and digits stay, A-Z become a-z, other ASCII becomes a blank; bytes of longer characters stay."""
    kept = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)}
    return bytes(b if b in kept else b + 32 if ord("A") <= b <= ord("Z") else 0x20 for b in range(256))


TABLE = _byte_table()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def hashes_of(words: Sequence[bytes], orders: int = ORDERS) -> list[int]:
    """CRC-32 of every run of 1 to ``orders`` words, joined by one blank."""
    seeds = list(map(crc32, words))
    found = list(seeds)
    spaced = [b" " + w for w in words] if orders > 1 else []
    for n in range(1, orders):
        seeds = list(map(crc32, spaced[n:], seeds))
        found += seeds
    return found


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """How often each bucket occurs in all texts: at most ``buckets`` numbers reach the driver."""
    ship(df.sparkSession)
    fields = [field("bucket", "long"), field("n", "long")]
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        held: Counter = Counter()

        def fold() -> None:
            hashes = np.fromiter(held.keys(), dtype=np.uint32, count=len(held)) % buckets
            np.add.at(total, hashes, np.fromiter(held.values(), dtype=np.int64, count=len(held)))
            held.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                for value in part.column("text").to_pylist():
                    held.update(hashes_of(words_of(value or ""), orders))
                    if len(held) > HELD:
                        fold()
        fold()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], schema=schema)

    counted = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, T.StructType(fields))
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        totals[row["bucket"]] = row["n"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain per bucket: 1000 times the log ratio of the smoothed frequencies, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def weights(df: DataFrame, gain: np.ndarray, text: str = "text", keep: Sequence[str] = (), orders: int = ORDERS) -> DataFrame:
    """``keep`` columns, ``n_features`` and ``weight``: the mean gain of a text's features, rounded down."""

    def make():
        def measure(texts: list[str]):
            sizes, means = [], []
            for value in texts:
                hashes = np.array(hashes_of(words_of(value), orders), dtype=np.uint32)
                sizes.append(len(hashes))
                means.append(int(gain[hashes % len(gain)].sum()) // len(hashes) if len(hashes) else 0)
            return [sizes, means]

        return measure

    return map_texts(df, text, keep, [field("n_features", "long"), field("weight", "long")], make)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``rank`` 1, 2, 3, ... along ``order``, which must be total."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = written(dealt.select(*keep, F.spark_partition_id().alias("_part"), place.alias("_at")), "ranked")
    # one row per partition: as many as the exchange has, whatever the data
    sizes = sorted(tuple(r) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return numbered.join(F.broadcast(starts), "_part").select(*keep, (F.col("_before") + F.col("_at") + 1).alias("rank"))


def cutoff(histogram: Sequence[tuple[int, int]], wanted: int) -> int | None:
    """The lowest score among the ``wanted`` highest of a histogram (score, rows); None if none is wanted."""
    for score, n in sorted(histogram, reverse=True):
        if wanted <= 0:
            break
        wanted -= n
        lowest = score
        if wanted <= 0:
            return lowest
    return None


def resample(
    df: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    orders: int = ORDERS,
    seed: int = SEED,
) -> DataFrame:
    """``keep`` columns (all by default), ``n_features``, ``weight``, ``score`` and ``rank`` of every document.

    Of the documents with ``least_words`` words, ``share`` percent (rounded down) are
    drawn and have a rank; ties go to the smaller id.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in RESULTS]
    gain = gains(bucket_counts(df, text, buckets, orders), bucket_counts(target, text, buckets, orders))
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    given = df.select(
        *[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")
    )
    measured = weights(given, gain, "_text", [*names, "_id"], orders)
    # at least w words give w + (w - 1) + ... features, at most ``orders`` terms
    least = sum(max(0, least_words - n) for n in range(orders))
    kept = [*names, "n_features", "weight", "score"]
    scored = measured.select(
        "*",
        (F.col("weight") + noise(F.col("_id"), seed)).alias("score"),
        (F.col("n_features") >= least).alias("_able"),
        F.monotonically_increasing_id().alias("_row"),
    )
    scored = written(scored, "scored")
    # scores are whole numbers between the extremes of gain and noise, about a hundred thousand values at most
    histogram = scored.where("_able").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = share * sum(r["n"] for r in histogram) // 100
    lowest = cutoff([(r["score"], r["n"]) for r in histogram], wanted)
    none = F.lit(None).cast("long").alias("rank")
    back = [*[F.col(k).alias(c) for k, c in names.items()], "n_features", "weight", "score", "rank"]
    if lowest is None:
        return scored.select(*kept, none).select(*back)
    near = F.col("_able") & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row").asc()]
    drawn = ranked(scored.where(near), order, kept)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(scored.where(~near).select(*kept, none)).select(*back)
