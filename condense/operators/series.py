"""Building blocks for ordered series that may be far too long for one task.

One camera or one clip may hold a third of all rows, so nothing here opens a
window over a whole series. A series is cut into *chunks*: a chunk number is
any column that never falls along the order of the series. Windows run inside
(key, chunk); what has to cross a chunk border travels as one summary row or
at most two border rows per chunk.

The plan is the same for every size: a short series simply has one chunk. Numbering
or folding a series with a NULL in its key fails, at any size; ``attach`` finds no
partner for such a row.

Three patterns cover the library:

``running``        exclusive running sum / max / min (prefix over chunk totals)
``with_halo``      border rows copied into the next chunk, for short frames
``coalesce_runs``  gaps and islands: join neighbours, then stitch the borders
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 65_536

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def chunk_size(n: int) -> int:
    """``n`` if it is a whole number of at least 1; a NULL chunk would put a whole series into one task."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"a chunk needs a whole number of rows, at least 1, not {n!r}")
    return n


def div(a: Column, n: int) -> Column:
    """Whole-number division by ``n`` >= 1, rounding down."""
    chunk_size(n)
    return F.floor(a / F.lit(n)).cast("long") if n != 1 else a.cast("long")


def _join_folds(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: dict[str, tuple[str, Column]],
    reverse: bool = False,
) -> DataFrame:
    """Add exclusive running folds: over all rows of the key strictly before each row.

    ``values`` maps a new column to (``sum`` | ``max`` | ``min``, input). With
    ``reverse`` the rows strictly after are folded. Sums start at 0, the other
    folds at NULL.
    """
    keys = list(keys)
    way = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    # rows without an order value come first, in a chunk of their own
    rows = df.withColumn("_chunk", F.coalesce(chunk.cast("long"), F.lit(-(2**62))))
    rows = rows.select("*", *[v.alias(f"_in_{n}") for n, (_, v) in values.items()])

    def before(window):
        return window.rowsBetween(W.unboundedPreceding, -1)

    totals = rows.groupBy(*keys, "_chunk").agg(
        *[_FOLD[how](f"_in_{n}").alias(f"_all_{n}") for n, (how, _) in values.items()]
    )
    over_chunks = before(W.partitionBy(*keys).orderBy(way("_chunk")))
    carried = totals.select(
        *keys,
        "_chunk",
        *[_FOLD[how](f"_all_{n}").over(over_chunks).alias(f"_to_{n}") for n, (how, _) in values.items()],
    )
    inside = before(W.partitionBy(*keys, "_chunk").orderBy(*[way(c) for c in order]))
    local = rows.select(
        "*", *[_FOLD[how](f"_in_{n}").over(inside).alias(f"_at_{n}") for n, (how, _) in values.items()]
    )
    carried = carried.withColumn("_found", F.lit(True))
    lost = F.raise_error(f"a series has a NULL in its key ({', '.join(keys)})")

    def whole(name: str, how: str) -> Column:
        value = _join_folds(how, F.col(f"_at_{name}"), F.col(f"_to_{name}"))
        return F.when(F.col("_found").isNull(), lost.cast(local.schema[f"_at_{name}"].dataType)).otherwise(value)

    # an outer join, so that a row with a NULL key meets the error instead of vanishing
    return local.join(carried, [*keys, "_chunk"], "left").select(
        *df.columns, *[whole(n, how).alias(n) for n, (how, _) in values.items()]
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "k"
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... along ``order`` (which must be total)."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("long"))})


def with_halo(
    df: DataFrame, keys: Sequence[str], idx: str, before: int = 0, after: int = 0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Copy border rows so that frames of ``before``/``after`` rows fit in one chunk.

    ``idx`` must be gapless per key. Adds ``_chunk`` and ``_own``: windows run
    over (keys, ``_chunk``), then rows with ``_own`` = false are dropped.
    """
    if max(before, after) > chunk_size(chunk_rows):
        raise ValueError("the frame is longer than a chunk")
    own, at = div(F.col(idx), chunk_rows), F.pmod(F.col(idx), F.lit(chunk_rows))
    homes = [own]
    if before:
        homes.append(F.when(at >= chunk_rows - before, own + 1))
    if after:
        homes.append(F.when((at < after) & (own > 0), own - 1))
    return (
        df.withColumn("_home", own)
        .withColumn("_chunk", F.explode(F.array_compact(F.array(*homes))))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def chunk_window(keys: Sequence[str], idx: str):
    return W.partitionBy(*keys, "_chunk").orderBy(idx)


def spread(per_key: DataFrame, last_idx: Column, chunk_rows: int) -> DataFrame:
    """One copy of a per-key row for every chunk of that key, as join partner.

    Joining on (key, ``_chunk``) keeps a hot key split over many tasks and
    reuses the partitioning the chunk windows need anyway.
    """
    return per_key.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), div(last_idx, chunk_rows))))


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    idx: str,
    last_idx: Column,
    chunk_rows: int = CHUNK_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join per-key values to the rows of a gapless series, chunk by chunk.

    Rows that carry their ``_chunk`` keep it, and with it the partitioning that
    later windows over the same chunks need.
    """
    side = spread(per_key, last_idx, chunk_rows)
    if "_chunk" in rows.columns:
        return rows.join(side, [*keys, "_chunk"], how)
    return rows.withColumn("_chunk", div(F.col(idx), chunk_rows)).join(side, [*keys, "_chunk"], how).drop("_chunk")


def coalesce_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    starts_run: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Join neighbouring rows into runs; the result has the columns of the input.

    ``columns`` says how each column of a run is made: ``first`` or ``last``
    (value of the first / last member), ``same`` (equal in all members),
    ``sum``, ``max`` or ``min``. ``order`` keeps the value of the first member.
    ``starts_run(prev, cur)`` tells whether a row does not continue its
    predecessor; it may look at ``last``/``same`` columns of ``prev`` and
    ``first``/``same`` columns of ``cur``. Such a test can be applied to runs as
    well as to rows, so rows are joined inside their chunk first and the chunks are
    stitched afterwards.
    """
    keys = list(keys)
    same = [c for c, how in columns.items() if how == "same"]

    def folded(group: list[str]):
        made = [F.min(order).alias(order)]
        for c, how in columns.items():
            if how == "first":
                made.append(F.min_by(c, order).alias(c))
            elif how == "last":
                made.append(F.max_by(c, order).alias(c))
            elif how != "same":
                made.append(_FOLD[how](c).alias(c))
        return group, made

    def prev(window):
        return lambda c: F.lag(c).over(window)

    within = W.partitionBy(*keys, "_chunk").orderBy(order)
    chunk = F.col("_chunk") if "_chunk" in df.columns else div(F.col(order), chunk_rows)
    marked = df.select(*keys, order, *columns, chunk.alias("_chunk"))
    marked = marked.withColumn(
        "_new", F.coalesce(starts_run(prev(within), F.col), F.lit(True)).cast("int")
    )
    marked = marked.withColumn("_run", F.sum("_new").over(within))
    marked = marked.withColumn("_runs", F.sum("_new").over(W.partitionBy(*keys, "_chunk")))
    group, made = folded([*keys, "_chunk", "_run", "_runs", *same])
    parts = marked.groupBy(*group).agg(*made)

    # Runs inside a chunk are finished and stay where they are; the border runs
    # of a key meet in one place, at most two per chunk.
    on_border = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    parts = parts.withColumn("_place", F.when(on_border, F.lit(-1).cast("long")).otherwise(F.col("_chunk")))
    along = W.partitionBy(*keys, "_place").orderBy("_chunk", "_run")
    apart = (F.lag("_chunk").over(along) == F.col("_chunk")) | starts_run(prev(along), F.col)
    parts = parts.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    parts = parts.withColumn("_join", F.sum("_new").over(along))
    group, made = folded([*keys, "_place", "_join", *same])
    return parts.groupBy(*group).agg(*made).select(*keys, order, *columns)


def runs_to_rows(
    rows: DataFrame,
    runs: DataFrame,
    keys: Sequence[str],
    idx: str,
    first: str,
    last: str,
    take: dict[str, str],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Give every row values of the run [``first``, ``last``] it lies in.

    ``take`` maps new columns to run columns. A run contributes one row to each
    chunk it touches and is then looked up by a running last value, so the work
    stays linear in rows + runs.
    """
    keys = list(keys)
    lo, hi = div(F.col(first), chunk_rows), div(F.col(last), chunk_rows)
    heads = runs.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn(
        "_at", F.greatest(F.col(first), F.col("_chunk") * chunk_rows)
    )
    heads = heads.select(*keys, "_chunk", "_at", F.lit(0).alias("_kind"), F.struct(*[F.col(c).alias(n) for n, c in take.items()]).alias("_val"))
    body = rows.select(
        *keys,
        div(F.col(idx), chunk_rows).alias("_chunk"),
        F.col(idx).alias("_at"),
        F.lit(1).alias("_kind"),
        F.struct(*[c for c in rows.columns if c not in keys]).alias("_row"),
    )
    w = W.partitionBy(*keys, "_chunk").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = body.unionByName(heads, allowMissingColumns=True).withColumn("_hit", F.last("_val", True).over(w))
    return found.where("_kind = 1").select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns],
        *[F.col(f"_hit.{n}").alias(n) for n in take],
    )
