"""Shared row plumbing of this package: batches of bounded size, runs of sorted keys, stored steps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from condense.session import ship

BATCH_CHARS = 2_000_000

#: Bytes of a batch on its way to a Python worker; whole texts have no bound of their own.
ARROW_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Spark sends to Python workers by bytes, unless the session says how large they may be."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, ARROW_BYTES)


#: Characters besides the blanks \x20 and \x09-\x0D at which str.split() also cuts.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than \\x20 and \\x09-\\x0D."""
    return _WORD.findall(text) if _OTHER_BLANKS.search(text) else text.split()


def arrow_schema(fields: Sequence[T.StructField]) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType), True) for f in fields])


def pieces(batch: pa.RecordBatch, text: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``text`` at most, one row at least."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    added: Sequence[T.StructField],
    make: Callable[[], Callable[[list[str]], Sequence[Iterable]]],
    limit: int = BATCH_CHARS,
) -> DataFrame:
    """``keep`` columns of ``df`` plus ``added`` ones computed from its ``text`` column.

    ``make()`` runs once per task and returns a function from a list of texts
    (NULL as "") to one list per added column. A kept column that has the name
    of an added one gives way to it.
    """
    ship(df.sparkSession)
    keep = [c for c in keep if c not in {f.name for f in added}]
    fields = [df.schema[c] for c in keep] + list(added)
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in pieces(batch, "__text", limit):
                made = compute([t or "" for t in part.column("__text").to_pylist()])
                old = [part.column(f"__k{i}") for i in range(len(keep))]
                new = [pa.array(v, type=schema.field(f.name).type) for f, v in zip(added, made)]
                old = [c.cast(schema.field(k).type) for c, k in zip(old, keep)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=schema)

    chosen = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("__text"))
    return chosen.mapInArrow(run, T.StructType(fields))


def map_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[T.StructField],
    work: Callable[[pa.Table], Iterable[pa.RecordBatch | pa.Table]],
    gather: int = 20_000,
) -> DataFrame:
    """Apply ``work`` to tables that hold whole runs of equal ``keys``.

    Rows are dealt by ``keys`` and sorted by ``keys`` and ``order``. Each call
    gets one or more complete runs, about ``gather`` rows together; a single run
    is never cut, so its length must be bounded by whoever made the keys.
    """
    ship(df.sparkSession)
    schema = arrow_schema(fields)
    keys = list(keys)

    def same(table: pa.Table, i: int, j: int) -> bool:
        return all(table.column(k)[i].as_py() == table.column(k)[j].as_py() for k in keys)

    def last_start(table: pa.Table) -> int:
        low, high = 0, table.num_rows - 1  # first row of the last run: rows are sorted
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if same(table, mid, table.num_rows - 1) else (mid + 1, high)
        return low

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for made in work(table.combine_chunks()):
            yield from (pa.Table.from_batches([made]) if isinstance(made, pa.RecordBatch) else made).cast(schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < gather:
                continue
            table = pa.Table.from_batches(held)
            cut = last_start(table)
            if cut:
                yield from out(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if rows:
            yield from out(pa.Table.from_batches(held))

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, T.StructType(list(fields)))


def runs(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Borders of the runs of equal keys."""
    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        values = table.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
    return zip(cuts, cuts[1:])


def pairs_of_blocks(df: DataFrame, blocks: Column, key: str, alone: bool = False) -> DataFrame:
    """Cut the rows of a group into ``blocks`` blocks by ``key``; a copy of each row for every pair of blocks it is in.

    Adds ``block`` and the pair (``i``, ``j``), i <= j; one block gives the pair (0, 0)
    only. Of several blocks, one meets itself inside its pairs with the others, or,
    with ``alone``, in a pair of its own.
    """
    block = F.pmod(F.xxhash64(key), blocks).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), blocks.cast("int") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    spread = df.withColumn("block", block).withColumn("_pair", F.explode(others))
    if not alone:
        spread = spread.filter((F.col("_pair.i") != F.col("_pair.j")) | (blocks == 1))
    return spread.withColumns({"i": F.col("_pair.i"), "j": F.col("_pair.j")}).drop("_pair")


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if " " in kind or "<" in kind else _KINDS[kind], True)


_KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "boolean": T.BooleanType(),
    "array_long": T.ArrayType(T.LongType()),
    "array_int": T.ArrayType(T.IntegerType()),
    "array_double": T.ArrayType(T.DoubleType()),
    "array_string": T.ArrayType(T.StringType()),
}


def null_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
