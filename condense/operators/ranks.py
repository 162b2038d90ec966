"""Exact order statistics per key without sorting a key in one task.

A mergeable sketch per key gives, for every wanted rank, two values that enclose it; only
values between them are sorted. The values below a bracket are counted exactly, and the
counts decide whether it holds its rank; where it should not, all values of the key are
taken, so the result never rests on the sketch. Neither the spacing of the values nor
their size matters, and equal values are counted before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from condense.functions.doubles import fused

#: Precision of the sketch: its ranks are off by at most n / ACCURACY.
ACCURACY = 10_000

#: Distance of a bracket's ends from the wanted rank, in units of n / ACCURACY.
MARGIN = 3

#: Tasks over which the values of one key meet its brackets.
COPIES = 16

Rank = Callable[[Column], Column]


def _copied(per_key: DataFrame) -> DataFrame:
    return per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))


def _inside(name: str) -> Column:
    """Whether a value lies in the bracket of a rank; a NULL end is open."""
    low, high = F.col(f"_from_{name}"), F.col(f"_to_{name}")
    return (low.isNull() | (F.col("_v") >= low)) & (high.isNull() | (F.col("_v") <= high))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values ``_v`` of each key with their count ``_c``, in ``COPIES`` parts per key."""
    values = df.where(F.col(value).isNotNull()).select(*keys, (F.col(value) + F.lit(0.0)).alias("_v"))
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counted.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(COPIES)).cast("int"))


def brackets(
    df: DataFrame,
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, tuple[float, Rank]],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per key: ``n`` and, for each rank, ``_from_``, ``_to_`` and the exact count ``_below_`` of values before it.

    Keys of at most 2 ``accuracy`` rows have open brackets. Elsewhere a bracket encloses at
    most 2 (``MARGIN`` + 1) / ``accuracy`` of a key's rows, and as many more as equal its ends.
    """
    reach = MARGIN / accuracy
    points = [end for q, _ in ranks.values() for end in (max(0.0, q - reach), min(1.0, q + reach))]
    values = df.where(F.col(value).isNotNull()).select(*keys, (F.col(value) + F.lit(0.0)).alias("_v"))
    sketched = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", points, accuracy).alias("_s")
    )
    many = F.col("n") > 2 * accuracy
    ends = [
        F.when(many, F.col("_s")[2 * at + side]).alias(f"_{end}_{name}")
        for at, name in enumerate(ranks)
        for side, end in enumerate(("from", "to"))
    ]
    tried = sketched.select(*keys, "n", *ends)
    sums = []
    for name in ranks:
        sums += [F.first(f"_from_{name}").alias(f"_from_{name}"), F.first(f"_to_{name}").alias(f"_to_{name}")]
        before = F.col("_v") < F.col(f"_from_{name}")
        sums.append(F.sum(F.when(before, F.col("_c")).otherwise(0)).alias(f"_below_{name}"))
        sums.append(F.sum(F.when(_inside(name), F.col("_c")).otherwise(0)).alias(f"_held_{name}"))
    totals = counted.join(_copied(tried), [*keys, "_part"]).groupBy(*keys).agg(F.first("n").alias("n"), *sums)
    checked = []
    for name, (_, rank) in ranks.items():
        r, below = rank(F.col("n")), F.col(f"_below_{name}")
        holds = (r >= below) & (r < below + F.col(f"_held_{name}"))
        checked += [F.when(holds, F.col(f"_{end}_{name}")).alias(f"_{end}_{name}") for end in ("from", "to")]
        checked.append(F.when(holds, below).otherwise(0).alias(f"_below_{name}"))
    return totals.select(*keys, "n", *checked)


def pick_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, tuple[float, Rank]], accuracy: int = ACCURACY
) -> DataFrame:
    """Per key: ``n`` and, for each name, the value at a 0-based rank.

    ``ranks`` maps a name to (share, rank): the rank as a function of ``n``, and about which
    share of the values lies before it. NULLs are no values; a key without values has no row.
    """
    keys = list(keys)
    counted = value_counts(df, keys, value)
    enclosed = brackets(df, counted, keys, value, ranks, accuracy)
    wanted = F.lit(False)
    for name in ranks:
        wanted = wanted | _inside(name)
    along = W.partitionBy(*keys).orderBy("_v")
    found = counted.join(_copied(enclosed), [*keys, "_part"]).where(wanted)
    found = found.select(
        *keys,
        "n",
        "_v",
        *[
            F.when(_inside(name), F.col(f"_below_{name}") + F.sum(F.when(_inside(name), F.col("_c"))).over(along)).alias(f"_cum_{name}")
            for name in ranks
        ],
    )
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[
            F.min(F.when(F.col(f"_cum_{name}") > rank(F.col("n")), F.col("_v"))).alias(name)
            for name, (_, rank) in ranks.items()
        ],
    )


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """Per key: ``n`` and linearly interpolated percentiles, one column per name.

    The mean of the two neighbours is rounded as DuckDB's ``quantile_cont`` does it, to the last
    bit: labels are judged by it, and values that equal a threshold are common.
    """

    def low(q):
        return lambda n: F.floor(F.lit(q) * (n - 1)).cast("long")

    def high(q):
        return lambda n: F.ceil(F.lit(q) * (n - 1)).cast("long")

    ranks = {}
    for name, q in fractions.items():
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = (q, low(q)), (q, high(q))
    picked = pick_ranks(df, keys, value, ranks, accuracy)

    def between(name: str, q: float) -> Column:
        pos = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = pos - F.floor(pos)
        return F.when(share == 0, lo).otherwise(fused(lo, 1.0 - share, hi * share)).alias(name)

    return picked.select(*keys, "n", *[between(name, q) for name, q in fractions.items()])
