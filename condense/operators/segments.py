"""STATIC / DYNAMIC segments: building, merging, absorbing short ones, reading and writing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from condense.operators.series import CHUNK_ROWS, attach, coalesce_runs, div, running, with_halo, with_position
from condense.schemas import SEGMENT_LIST
from condense.session import ship, written

DAY = ["date", "cam_index"]
SEGMENT_COLUMNS = {
    "start_time": "first",
    "end_time": "last",
    "state": "same",
    "source_file": "first",
    "file_start_offset": "first",
    "max_energy": "max",
}


def state_of(is_motion: Column) -> Column:
    return F.when(is_motion, "DYNAMIC").otherwise("STATIC")


def runs_to_segments(runs: DataFrame, source: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Segments of each file from its smoothed runs, numbered by ``seq`` in order."""
    return runs.select(
        "file_id",
        F.col("first_i").alias("seq"),
        "start_time",
        "end_time",
        state_of(F.col("is_motion")).alias("state"),
        (F.col("file_id") if source is None else source).cast("string").alias("source_file"),
        (F.lit(0.0) if offset is None else offset).alias("file_start_offset"),
        "max_energy",
    )


def _new_segment(tolerance: float):
    return lambda prev, cur: (prev("state") != cur("state")) | (
        cur("start_time") - prev("end_time") > F.lit(float(tolerance))
    )


def merge_segments(
    segments: DataFrame,
    keys: Sequence[str] = DAY,
    seq: str = "seq",
    tolerance: float = 0.5,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Merge neighbours of equal state at most ``tolerance`` apart.

    A merged segment ends where its *last* member ends and keeps source file and
    offset of the first.
    """
    return coalesce_runs(segments, keys, seq, SEGMENT_COLUMNS, _new_segment(tolerance), chunk_rows)


# What the segments so far have left behind, one digit each: 0 nothing yet; 1 / 2 a kept segment, at
# rest / in motion; 3 / 4 the same, with the last segment handed on to the next one, which is still
# too short; 5 nothing kept, the last segment handed on; 6 handed on to one that is long enough now.
BEFORE = "0123456"

# What a row's flags say of its segment (or, for the last two, of the next one).
MOVES, SHORT, SHORT_FIRST, TURNS, TAKEN = 1, 2, 4, 8, 16
HEAD = 32


@cache
def _place(before: str, flags: int) -> tuple[str, str]:
    """What becomes of a segment and what it leaves behind, for each state in ``before``.

    What becomes of it is 2 if it starts a new segment, plus 1 if its state and source
    are those of the segment it goes into.
    """
    own = 2 if flags & MOVES else 1
    became, left = "", ""
    for state in map(int, before):
        if state in (0, 5):
            passed_on = flags & SHORT_FIRST and flags & TURNS
            then = (2 if state == 0 else 0) + (0 if passed_on else 1), 5 if passed_on else own
        elif state in (3, 4):
            then = 0, state - 2
        elif state == 6:
            then = 1, own
        elif flags & SHORT and state != own:
            then = 0, state
        elif flags & SHORT and flags & TURNS:
            then = (0, state + 2) if flags & TAKEN else (2, 6)
        else:
            then = 3, own
        became, left = became + str(then[0]), left + str(then[1])
    return became, left


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to ordered rows what becomes of each, and what its chunk has left up to it, for every state before the chunk."""
    left = BEFORE
    for batch in batches:
        became, so_far = [], []
        for flags in batch.column("_flags").to_pylist():
            here, left = _place(BEFORE if flags & HEAD else left, flags & (HEAD - 1))
            became.append(here)
            so_far.append(left)
        columns = [*batch.columns, pa.array(became, pa.string()), pa.array(so_far, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_became", "_left"])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the ordered chunks of each key the state before them."""
    state = 0
    for batch in batches:
        states = []
        for head, left in zip(batch.column("_first").to_pylist(), batch.column("_left").to_pylist()):
            state = 0 if head else state
            states.append(state)
            state = int(left[state])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.int32())], [*batch.schema.names, "_state"])


def _flagged(now: DataFrame, keys: list[str], seq: str, min_motion: float, min_static: float, chunk: Column) -> DataFrame:
    """Segments with ``_chunk`` and ``_flags``, partitioned by chunk and ordered inside."""
    no_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    lost = F.raise_error(f"a series has a NULL in its key ({', '.join(keys)})").cast("long")
    rows = now.withColumn("_chunk", F.when(no_key, lost).otherwise(chunk)).repartition(*keys, "_chunk")
    part = F.struct("start_time", "end_time", "state")
    borders = rows.groupBy(*keys, "_chunk").agg(F.min_by(part, seq).alias("_head"))
    chunks = W.partitionBy(*keys).orderBy("_chunk")
    borders = borders.select(
        *keys,
        "_chunk",
        F.first("_head.start_time").over(chunks).alias("_first_start"),
        F.lead("_head").over(chunks).alias("_right"),
    )
    within = W.partitionBy(*keys, "_chunk").orderBy(seq)
    # an outer join, so that a NULL in the key meets the error instead of vanishing
    rows = rows.join(borders, [*keys, "_chunk"], "left").select(
        *now.columns,
        "_chunk",
        "_first_start",
        F.coalesce(F.lead(part).over(within), F.col("_right")).alias("_after"),
        (F.row_number().over(within) == 1).alias("_head"),
    )

    def short(start: Column, end: Column, state: Column) -> Column:
        least = F.when(state == "DYNAMIC", F.lit(float(min_motion))).otherwise(F.lit(float(min_static)))
        return end - start < least

    own = (F.col("end_time"), F.col("state"))
    turns = F.col("_after.state") != F.col("state")
    tests = {
        MOVES: F.col("state") == "DYNAMIC",
        SHORT: short(F.col("start_time"), *own),
        SHORT_FIRST: short(F.col("_first_start"), *own),
        TURNS: turns,
        TAKEN: turns & short(F.col("start_time"), F.col("_after.end_time"), F.col("_after.state")),
        HEAD: F.col("_head"),
    }
    flags = reduce(lambda x, y: x + y, [F.when(test, bit).otherwise(0) for bit, test in tests.items()])
    return rows.select(*now.columns, "_chunk", flags.cast("int").alias("_flags"))


# Passes that a chunk makes at once, and the part of a chunk it borrows from either neighbour for that.
PASSES, BORROWED = 16, 16
SETTLED, UNSETTLED, LOST = 0, 1, 2


@cache
def _steps() -> list[int]:
    """For state * HEAD + flags: what becomes of a segment * 8 + the state it leaves behind."""
    placed = [_place(BEFORE, flags) for flags in range(HEAD)]
    return [int(became[i]) * 8 + int(left[i]) for i in range(len(BEFORE)) for became, left in placed]


def _runs(new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First members, and one after the last members, of the runs that begin where ``new``."""
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)


def _pass(now: tuple, given: dict, open_left: bool, open_right: bool) -> tuple[tuple, float, bool]:
    """One pass over a stretch of merged segments; an open end has unknown segments beyond it.

    ``now`` holds per segment the rows of its start, its end and its state, and its energy.
    Only segments that the unknown ones can't change are returned, with the row of the first
    segment left out at the right and whether anything changed.
    """
    head, tail, named, energy = now
    n = len(head)
    start, end, state = given["start"][head], given["end"][tail], given["state"][named]
    least = given["least"][named]
    turns, taken = np.zeros(n, bool), np.zeros(n, bool)
    turns[:-1] = (state[1:] != state[:-1]) & (state[1:] >= 0) & (state[:-1] >= 0)
    taken[:-1] = turns[:-1] & (end[1:] - start[:-1] < least[1:])
    short, short_first = end - start < least, end - given["first_start"] < least
    flags = given["moves"][named] * MOVES + short * SHORT + short_first * SHORT_FIRST + turns * TURNS + taken * TAKEN
    flags, before, at = flags.tolist(), BEFORE[1:] if open_left else BEFORE[0], 0
    while len(set(before)) > 1 and at < n:
        before, at = _place(before, flags[at])[1], at + 1
    state_at, steps, became = int(before[0]) * HEAD, _steps(), []
    for flag in flags[at : n - 1 if open_right else n]:
        step = steps[state_at + flag]
        became.append(step >> 3)
        state_at = (step & 7) * HEAD
    became = np.array(became, np.int64)

    # segments that became one; the last may go on beyond an open end
    first, stop = _runs(became >= 2, len(became))
    if open_right:
        first, stop = first[:-1], stop[:-1]
    odd = np.flatnonzero(became % 2 == 1)
    whose = odd[np.minimum(np.searchsorted(odd, first), len(odd) - 1)] if len(odd) else first
    first, stop, whose = first + at, stop + at, named[whose + at]

    # neighbours merged; the first and the last run may go on beyond an open end
    gap = start[first[1:]] - end[stop[:-1] - 1]
    state = given["state"][whose]
    new = np.ones(len(first), bool)
    new[1:] = (state[1:] != state[:-1]) | (state[1:] < 0) | ~(gap <= given["tolerance"])
    since, until = _runs(new, len(first))
    beyond = np.inf
    if open_right:
        beyond = head[first[since[-1]]] if len(since) else -1
        since, until = since[:-1], until[:-1]
    if open_left:
        since, until = since[1:], until[1:]
    if not len(since):
        return (head[:0], tail[:0], named[:0], energy[:0]), beyond, True
    a, b = first[since], stop[until - 1]
    highest = np.maximum.reduceat(energy[: b[-1]], a)
    return (head[a], tail[b - 1], whose[since], highest), beyond, bool(b[-1] - a[0] != len(a))


def _settle(keys: list[str], seq: str, schema: pa.Schema, min_motion: float, min_static: float, tolerance: float):
    """Up to ``PASSES`` passes over a chunk with the segments borrowed from its neighbours.

    Returns its own segments and a row without ``seq`` that says how it ended: SETTLED,
    UNSETTLED (the last pass changed something) or LOST (what lies beyond matters).
    """

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        own = np.flatnonzero(table.column("_own").to_numpy())
        if not len(own):  # lent to a chunk beyond the last one
            return schema.empty_table()
        at, last, first_start = (table.column(c)[0].as_py() for c in ("_pos", "_last", "_first_start"))
        open_left, open_right = at > 0, table.column("_pos")[-1].as_py() < last
        codes = table.column("state").combine_chunks().dictionary_encode()
        state = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        moves = np.array([s == "DYNAMIC" for s in codes.dictionary.to_pylist()] + [False])[state]
        number = lambda c: table.column(c).cast("double").to_numpy()  # noqa: E731  (NULL as NaN: neither is short)
        given = {
            "start": number("start_time"),
            "end": number("end_time"),
            "first_start": np.nan if first_start is None else first_start,
            "state": state,
            "moves": moves,
            "least": np.where(moves, float(min_motion), float(min_static)),
            "tolerance": float(tolerance),
        }
        rows = np.arange(len(table))
        absent = table.column("max_energy").is_null().to_numpy()
        now, said, beyond = (rows, rows, rows, np.where(absent, -np.inf, number("max_energy"))), LOST, np.inf
        for _ in range(PASSES):
            now, edge, changed = _pass(now, given, open_left, open_right)
            beyond = min(beyond, edge)
            if not len(now[0]) or (open_left and now[0][0] > own[0]) or (open_right and beyond <= own[-1]):
                now, said = tuple(x[:0] for x in now), LOST
                break
            said = UNSETTLED if changed else SETTLED
            if not (changed or open_left or open_right):
                break
        mine = (now[0] >= own[0]) & (now[0] <= own[-1])
        head, tail, named, energy = (x[mine] for x in now)
        present = np.append(0, np.cumsum(~absent))
        nothing = present[tail + 1] == present[head]
        made = {c: table.column(c).take(pa.array(head)) for c in [*keys, seq, "start_time"]}
        made["end_time"] = table.column("end_time").take(pa.array(tail))
        made |= {c: table.column(c).take(pa.array(named)) for c in ("state", "source_file", "file_start_offset")}
        made["max_energy"] = pa.array(energy, mask=nothing)
        made["_said"] = pa.nulls(len(head), pa.int32())
        how = {f.name: pa.nulls(1, f.type) for f in schema} | {"_said": pa.array([said], pa.int32())}
        return pa.concat_tables([pa.table({f.name: made[f.name] for f in schema}).cast(schema), pa.table(how, schema)])

    return settle


def _settled(now: DataFrame, keys: list[str], seq: str, chunk_rows: int, rule: tuple[float, float, float]) -> tuple[DataFrame, int]:
    """Merged segments after as many passes as every chunk makes on its own, and how the worst chunk ended."""
    near = max(1, chunk_rows // BORROWED)
    per_key = now.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_last"), F.min_by("start_time", seq).alias("_first_start"))
    rows = with_position(now, keys, [seq], div(F.col(seq), chunk_rows), "_pos")
    rows = with_halo(rows, keys, "_pos", near, near, chunk_rows)
    # an outer join, so that a NULL in the key meets the error of the numbering instead of vanishing
    rows = attach(rows, per_key, keys, "_pos", F.col("_last"), chunk_rows, "left")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in now.schema] + [T.StructField("_said", T.IntegerType())])
    settle = _settle(keys, seq, to_arrow_schema(schema), *rule)
    done = written(rows.groupBy(*keys, "_chunk").applyInArrow(settle, schema), "settled")
    return done.where("_said IS NULL").drop("_said"), done.agg(F.coalesce(F.max("_said"), F.lit(SETTLED))).first()[0]


def absorb_short(
    segments: DataFrame,
    keys: Sequence[str] = DAY,
    seq: str = "seq",
    min_motion: float = 2.0,
    min_static: float = 30.0,
    tolerance: float = 0.5,
    chunk_rows: int = CHUNK_ROWS,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> DataFrame:
    """Absorb short segments into their neighbours, pass by pass until stable.

    A short segment goes into the segment kept before it if that has the other state, else
    into the one after it; then neighbours are merged, and the next pass begins. What
    becomes of a segment depends on all before it, but only through seven states, so every
    chunk of a series is folded at the same time, for each state it may be entered in. The
    chunks of a key, one row each, are then followed through in order, which picks the
    state that holds, and the segments that became one are grouped. So no series and no
    stretch of short segments lies in one task.

    Most passes need nothing of this: what a segment feels ends at the next one that stays as
    it is. So a chunk first makes ``PASSES`` passes at once with segments borrowed from its
    neighbours, and leaves out what those beyond could change. Where that reaches its own
    segments in any chunk, all chunks make one pass as above instead, and then try again.

    The outcome of either is stored. The merged input is handed to ``keep``, which may store
    it. A NULL in a key fails the job.
    """
    keys = list(keys)
    chunk = div(F.col(seq), chunk_rows)
    now = keep(merge_segments(segments, keys, seq, tolerance, chunk_rows), "merged")
    ship(segments.sparkSession)
    while True:
        alone, ended = _settled(now, keys, seq, chunk_rows, (min_motion, min_static, tolerance))
        if ended == SETTLED:
            return alone
        if ended == UNSETTLED:
            now = alone
            continue
        flagged = _flagged(now, keys, seq, min_motion, min_static, chunk).sortWithinPartitions(*keys, "_chunk", seq)
        schema = T.StructType([*flagged.schema.fields, T.StructField("_became", T.StringType()), T.StructField("_left", T.StringType())])
        rows = written(flagged.mapInArrow(_placed, schema), "absorbed")
        chunks = rows.groupBy(*keys, "_chunk").agg(F.max_by("_left", seq).alias("_left"))
        chunks = chunks.withColumn("_first", F.row_number().over(W.partitionBy(*keys).orderBy("_chunk")) == 1)
        chunks = chunks.sortWithinPartitions(*keys, "_chunk")
        schema = T.StructType([*chunks.schema.fields, T.StructField("_state", T.IntegerType())])
        states = chunks.mapInArrow(_entered, schema).select(*keys, "_chunk", "_state")
        became = F.substring("_became", F.col("_state") + 1, F.lit(1)).cast("int")
        rows = rows.join(states, [*keys, "_chunk"]).select(*now.columns, became.alias("_became"))
        if rows.where("_became != 3").isEmpty():
            return now
        starts = F.col("_became") >= 2
        rows = running(rows, keys, [seq], chunk, {"_since": ("max", F.when(starts, F.col(seq)))})
        rows = rows.withColumn("_into", F.when(starts, F.col(seq)).otherwise(F.col("_since")))
        named = F.struct("state", "source_file", "file_start_offset")
        whole = rows.groupBy(*keys, "_into").agg(
            F.min_by("start_time", seq).alias("start_time"),
            F.max_by("end_time", seq).alias("end_time"),
            F.max("max_energy").alias("max_energy"),
            F.first(F.when(F.col("_became") % 2 == 1, named), ignorenulls=True).alias("_named"),
        )
        whole = whole.select(*keys, F.col("_into").alias(seq), "start_time", "end_time", "max_energy", "_named.*")
        now = written(merge_segments(whole, keys, seq, tolerance, chunk_rows).select(*now.columns), "merged")


def segments_to_json(segments: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One JSON list per key with its segments in the order of ``seq``, in ``analysis_segments``.

    The list is one value of the clip's registry row, so a key is a clip, not a day.
    """
    item = F.struct(*SEGMENT_COLUMNS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), item.alias("s")))), lambda x: x["s"])
    return segments.groupBy(*keys).agg(F.to_json(ordered).alias("analysis_segments"))


def segments_from_json(clips: DataFrame, column: str = "analysis_segments") -> DataFrame:
    """Rows of segments with ``seq`` from stored JSON; a missing energy is 0.0."""
    others = [c for c in clips.columns if c != column]
    parsed = F.from_json(F.col(column), SEGMENT_LIST)
    rows = clips.select(*others, F.posexplode(parsed).alias("seq", "_s"))
    return rows.select(
        *others,
        F.col("seq").cast("long").alias("seq"),
        *[F.col(f"_s.{c}").alias(c) for c in SEGMENT_COLUMNS if c != "max_energy"],
        F.coalesce("_s.max_energy", F.lit(0.0)).alias("max_energy"),
    )


def transitions(runs: DataFrame, first: int | None = None) -> DataFrame:
    """Where the label changes. Every run but the one at 0 begins with a change.

    ``first`` keeps the first so many changes of each file.
    """
    changes = runs.where("first_i > 0").select(
        "file_id",
        F.col("first_i").alias("i"),
        *[F.col("start_time").alias("time") for c in runs.columns if c == "start_time"],
        F.when(F.col("is_motion"), "MOTION_START").otherwise("MOTION_END").alias("direction"),
    )
    if first is None:
        return changes
    rank = F.row_number().over(W.partitionBy("file_id").orderBy("i"))
    return changes.withColumn("_rank", rank).where(F.col("_rank") <= first).drop("_rank")


def midpoints(segments: DataFrame, longer_than: float = 10.0) -> DataFrame:
    """Middle of every segment longer than ``longer_than`` seconds."""
    span = F.col("end_time") - F.col("start_time")
    return segments.where(span > longer_than).withColumn("midpoint", (F.col("start_time") + F.col("end_time")) / 2)
