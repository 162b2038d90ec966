"""Connected components of a table of links, by alternating large-star and small-star steps.

A large-star step links every node's larger neighbours to the smallest node among
its neighbours and itself; a small-star step does so with its smaller neighbours.
Both keep the components, and in the end every node is linked to the smallest of
its component alone. Each step is written to the shared folder, so lineage stays
short and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from condense.session import written


def _state(links: DataFrame) -> tuple:
    code = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(code), F.bit_xor(F.xxhash64(code))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every linked node; the component is its smallest node.

    Links with a NULL end and links of a node with itself are passed over.
    """
    at = F.col(a), F.col(b)
    now = written(
        links.filter(at[0] != at[1]).select(F.greatest(*at).alias("u"), F.least(*at).alias("v")).distinct(), "links"
    )
    state = _state(now)
    while state[0]:
        moved = written(_small_star(_large_star(now)), "links")
        after = _state(moved)
        now = moved
        if after == state:
            break
        state = after
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
