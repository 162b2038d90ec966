"""Frames held as BINARY, one byte per value: measured in one ordered pass over each chunk.

The frames of a (file, chunk) meet in one partition, sorted, and pass through an
Arrow batch at a time; the pass keeps the first and the previous frame as arrays, so
no pixels are copied into a second column and no window buffers them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from condense.operators.series import spread, with_halo
from condense.session import ship

FILE = ["file_id"]
#: Place of the first frame of a file in the order of each chunk: before all frames.
HEAD = -1

Measure = Callable[[np.ndarray, "np.ndarray | None", "np.ndarray | None"], tuple]


def total_abs_diff(a: np.ndarray | None, b: np.ndarray | None) -> int | None:
    """Sum of absolute differences; None if a frame is missing or the sizes differ."""
    if a is None or b is None or a.size != b.size:
        return None
    return int(np.abs(a.astype(np.int16) - b).sum(dtype=np.int64))


def _mean(total: int | None, size: int) -> float | None:
    return None if total is None or not size else total / size


def change(cur: np.ndarray | None, prev: np.ndarray | None, first: np.ndarray | None) -> tuple:
    """Mean of a frame, mean absolute difference to the previous and to the first frame."""
    if cur is None:
        return None, None, None
    return (
        _mean(int(cur.sum(dtype=np.int64)), cur.size),
        _mean(total_abs_diff(cur, prev), cur.size),
        _mean(total_abs_diff(cur, first), cur.size),
    )


def energy_over(area: int) -> Measure:
    """Absolute difference to the previous frame over the nominal area of the box."""
    return lambda cur, prev, first: (_mean(total_abs_diff(cur, prev), area),)


def _walk(names: list[str], measure: Measure) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = first = prev = None
        for batch in batches:
            files, chunks, order = (batch.column(c).to_pylist() for c in (*FILE, "_chunk", "i"))
            found = []
            for n, raw in enumerate(batch.column("pixels")):
                cur = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else None
                if (files[n], chunks[n]) != place:
                    place, first, prev = (files[n], chunks[n]), None, None
                if order[n] == HEAD:
                    first = cur
                    found.append((None,) * len(names))
                    continue
                found.append(measure(cur, prev, first))
                prev = cur
            measured = [pa.array([row[m] for row in found], pa.float64()) for m in range(len(names))]
            kept = [batch.column(c) for c in (*FILE, "i", "_chunk")]
            made = pa.RecordBatch.from_arrays([*kept, *measured], names=[*FILE, "i", "_chunk", *names])
            yield made.filter(batch.column("_own"))

    return walk


def measured(
    frames: DataFrame, names: list[str], measure: Measure, chunk_rows: int, with_first: bool = False
) -> DataFrame:
    """``file_id``, ``i``, ``_chunk`` and the ``names`` that ``measure(frame, previous, first)`` returns.

    A frame without pixels has no values, and none are measured against it. Rows
    without a file are left out. The first frame of a file, if wanted, travels once
    into each of its chunks; all other pixels are shuffled once, border frames of a chunk twice.
    """
    ship(frames.sparkSession)
    rows = frames.select(*FILE, F.col("i").cast("long").alias("i"), "pixels").dropna(subset=FILE)
    columns = [*FILE, "_chunk", "i", "_own", "pixels"]
    laid = with_halo(rows, FILE, "i", before=1, chunk_rows=chunk_rows).select(*columns)
    if with_first:
        size = rows.groupBy(*FILE).agg(F.max("i").alias("_last_i"))
        heads = spread(rows.where("i = 0").join(size, FILE), F.col("_last_i"), chunk_rows)
        heads = heads.withColumns({"i": F.lit(HEAD).cast("long"), "_own": F.lit(False)})
        laid = laid.unionByName(heads.select(*columns))
    ordered = laid.repartition(*FILE, "_chunk").sortWithinPartitions(*FILE, "_chunk", "i")
    key = rows.schema[FILE[0]].dataType.simpleString()
    schema = f"{FILE[0]} {key}, i long, _chunk long, " + ", ".join(f"{n} double" for n in names)
    return ordered.mapInArrow(_walk(names, measure), schema)
