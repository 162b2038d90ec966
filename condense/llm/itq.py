"""Near-duplicate vectors: balanced binary codes, multi-index Hamming tables, exact rerank.

Iterative quantisation learns rotations of the centred, whitened vectors that bring
them close to the corners of a cube, so each bit splits the vectors in halves. Every
rotation gives ``TABLES`` parts of ``PART_BITS`` bits; each part is the key of one table,
and two vectors meet in a table if they agree in that part. How many rotations are
needed depends on the vectors: the more they have in common, the further a linked pair
is apart once the mean is taken off. So the fitted sample decides: its own pairs just
over the threshold, and pairs planted exactly at it around its vectors, must meet in at
least ``RECALL`` of the cases. Where ``ROTATIONS`` rotations don't reach that, and where
there are at most ``BLOCK`` vectors, all vectors of a label are compared with each other.
Vectors of each length have rotations and tables of their own.
In a bucket, vectors are compared by their cosine in double precision; a pair counts
in the first table in which it meets, so it counts once. Only counts and a spanning
forest of the links leave a bucket, never its pairs.

Buckets larger than ``BLOCK`` are compared in pairs of blocks, each a unit of its own.

The rotations are fitted on at most ``SAMPLE`` vectors, chosen by a hash of the row; every
vector is indexed.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite
components, and vectors without label or id, link with nothing and are their own
component. Vectors of different lengths never link, equal ones are linked like others.
Repeated ids are one vector for components, and each row has its own count. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from condense.llm.components import components
from condense.llm.rows import arrow_schema, field, map_runs, pairs_of_blocks, runs
from condense.session import ship, written

SAMPLE = 10_000
ROUNDS = 30
TABLES, PART_BITS = 8, 8  # of one rotation
ROTATIONS = 8
RECALL = 0.995
BLOCK = 2_000


def fit_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) learned from the rows of ``sample``."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    values, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
    axes = axes[:, np.argsort(values)[::-1]]
    if axes.shape[1] < bits:  # fewer dimensions than bits: further random directions
        more = np.random.default_rng(seed).normal(size=(axes.shape[0], bits - axes.shape[1]))
        axes = np.hstack([axes, more / np.linalg.norm(more, axis=0)])
    axes = axes[:, :bits]
    projected = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        corners = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(corners.T @ projected)
        rotation = vt.T @ u.T
    return mean, axes @ rotation


def _lists(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as vectors of length 1 in double precision."""
    rows = _lists(column).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: str, label: str) -> Column:
    """Whether a row may link with any other."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & fine & some, F.lit(False))


def coded(units: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of vectors of length 1, a table's part per byte."""
    return np.packbits((units - mean) @ projection >= 0, axis=1)


def _coded(rows: DataFrame, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add ``code``, the keys of a vector in the tables of its length; one key for all where a length has none."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, field("code", "array<tinyint>")])
    arrow = arrow_schema(schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == size))
                code = np.zeros((own.num_rows, 1), dtype=np.int8)
                if size in tables:
                    code = coded(_matrix(own.column("vector")), *tables[size]).view(np.int8)
                ends = np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]
                columns = [c.cast(f.type) for c, f in zip(own.columns, arrow)]
                code = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.ravel())).cast(arrow.field("code").type)
                yield pa.RecordBatch.from_arrays([*columns, code], schema=arrow)

    return rows.mapInArrow(run, schema)


FOUND = [field("row", "long"), field("id", "long"), field("n", "long"), field("root", "long")]
UNIT = ["label", "size", "part", "key", "i", "j"]


def _compare(threshold: float):
    def work(table: pa.Table) -> Iterable[pa.Table]:
        rows, ids = table.column("row").to_numpy(), table.column("id").to_numpy()
        blocks = table.column("block").to_numpy()
        parts, lows, highs = (table.column(c).to_numpy() for c in ("part", "i", "j"))
        found: list[tuple[int, int, int, int]] = []
        for start, end in runs(table, UNIT):
            x, code = _matrix(table.column("vector").slice(start, end - start)), _lists(table.column("code").slice(start, end - start))
            block = blocks[start:end]
            across = lows[start] != highs[start]
            counts, root = np.zeros(end - start, dtype=np.int64), list(range(end - start))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for at in range(0, end - start, 256):
                a, b = np.nonzero(x[at : at + 256] @ x[at:].T >= threshold)
                a, b = a[a < b] + at, b[a < b] + at
                keep = block[a] != block[b] if across else np.ones(len(a), dtype=bool)
                a, b = a[keep], b[keep]
                for earlier in range(parts[start]):  # a pair counts in the first table it meets in
                    first = code[a, earlier] != code[b, earlier]
                    a, b = a[first], b[first]
                counts += np.bincount(a, minlength=end - start) + np.bincount(b, minlength=end - start)
                for p, q in zip(a.tolist(), b.tolist()):
                    p, q = top(p), top(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
            for k in np.flatnonzero(counts).tolist():
                found.append((rows[start + k], ids[start + k], counts[k], ids[start + top(k)]))
        columns = np.array(found, dtype=np.int64).reshape(-1, 4).T
        yield pa.table(dict(zip(("row", "id", "n", "root"), columns)))

    return work


def border_pairs(sample: np.ndarray, threshold: float, most: int = 5_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of pairs that are hard to find: the sample's own just over the threshold, and pairs planted at it.

    A planted partner lies off its vector in a random direction, or in the direction in
    which two vectors of the sample differ.
    """
    dice = np.random.default_rng(17)
    n, size = sample.shape
    x = sample[dice.permutation(n)[:most]] if n >= most else sample[dice.integers(n, size=most)]
    out = []
    for aside in (dice.normal(size=x.shape), sample[dice.integers(n, size=most)] - sample[dice.integers(n, size=most)]):
        aside = aside - (aside * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(aside, axis=1)
        some = length > 1e-9
        aside = aside[some] / length[some, None]
        out.append((x[some], threshold * x[some] + np.sqrt(max(0.0, 1 - threshold**2)) * aside))
    own: list[np.ndarray] = []
    for at in range(0, n, 256):
        cosines = sample[at : at + 256] @ sample[at:].T
        a, b = np.nonzero((cosines >= threshold) & (cosines < threshold + 0.02))
        pairs = np.stack([a + at, b + at], axis=1)[a < b]
        own.append(pairs[dice.permutation(len(pairs))[: 1 + most * 256 // n]])
    a, b = np.concatenate(own).T
    return [(p, q) for p, q in [*out, (sample[a], sample[b])] if len(p) >= 100]


def fit(vectors: DataFrame, threshold: float, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection from at most ``sample`` usable rows (``row``, ``vector``); no columns where no tables are worth it."""
    chosen = vectors.orderBy(F.xxhash64("row"), "row").limit(sample).select("vector").toPandas()["vector"]
    units = _matrix(pa.array(chosen.tolist()))
    return fit_tables(units, threshold)


def fit_tables(units: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As many rotations as the pairs at the border need to meet; none if ``ROTATIONS`` don't do."""
    pairs = border_pairs(units, threshold)
    met = [np.zeros(len(p), dtype=bool) for p, _ in pairs]
    projections: list[np.ndarray] = []
    for k in range(ROTATIONS):
        mean, projection = fit_rotation(units, TABLES * PART_BITS, seed=11 + k)
        projections.append(projection)
        met = [m | (coded(p, mean, projection) == coded(q, mean, projection)).any(axis=1) for m, (p, q) in zip(met, pairs)]
        if all(m.mean() >= RECALL for m in met):
            return mean, np.hstack(projections)
    return mean, np.zeros((units.shape[1], 0))


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.93,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    named = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    rows = written(named.withColumn("row", F.monotonically_increasing_id()), "itq-rows")
    fine = rows.filter(F.col("id").isNotNull() & usable("vector", "label")).withColumn("size", F.size("vector"))
    if fine.isEmpty():
        counted = rows.select("row", F.lit(0).cast("long").alias("n")).limit(0)
        joined = rows.select("id", F.col("id").alias("component_id")).limit(0)
    else:
        many = fine.groupBy("size").count().filter(F.col("count") > BLOCK).collect()
        tables = {r["size"]: fit(fine.filter(F.col("size") == r["size"]), threshold) for r in many}
        codes = written(_coded(fine, {n: t for n, t in tables.items() if t[1].shape[1]}), "itq-codes")
        spread = codes.select("*", F.posexplode("code").alias("part", "key"))
        buckets = spread.groupBy("label", "size", "part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        sized = spread.join(buckets, ["label", "size", "part", "key"])
        count = F.ceil(F.col("n") / BLOCK)
        units = pairs_of_blocks(sized, count, "row", alone=True).drop("n")
        found = written(map_runs(units, UNIT, ["row"], FOUND, _compare(threshold)), "itq-links")
        counted = found.groupBy("row").agg(F.sum("n").alias("n"))
        joined = components(found, "id", "root").select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    out = rows.select("row", "id").join(counted, "row", "left").join(joined, "id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        (F.col("component_id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"),
    )
