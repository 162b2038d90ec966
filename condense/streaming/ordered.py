"""Stateful folds over rows that may arrive out of order.

Rows of one key carry a gapless index and the length of their series. The state
of a key holds what the fold remembers and the rows that came too early; a row
is folded when all rows before it have been. When a key is decided its state
shrinks to a mark that later rows are ignored.

Each key is one state of one task, so a key should be what is watched as one
thing: a clip, or a camera's day.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from condense.session import ship

STATE = "body binary"

# start() -> memory; step(memory, row, is_last) -> (memory, output rows, decided)
Step = Callable[[object, dict, bool], tuple[object, list[tuple], bool]]


def ordered_fold(
    stream: DataFrame,
    keys: list[str],
    idx: str,
    total: str,
    start: Callable[[], object],
    step: Step,
    output: StructType,
    forget_after_ms: int | None = None,
) -> DataFrame:
    """Fold the rows of every key in the order of ``idx``, whatever the order of arrival.

    ``output`` has the keys first, then what ``step`` returns. Marks of decided
    keys are dropped after ``forget_after_ms`` if given.
    """
    columns = [f.name for f in output.fields]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory, at, early, decided = pickle.loads(state.get[0]) if state.exists else (start(), 0, {}, False)
        out: list[tuple] = []
        for pdf in batches:
            if decided:
                continue
            for row in pdf.to_dict("records"):
                if row[idx] >= at:
                    early[row[idx]] = row
            while not decided and at in early:
                row = early.pop(at)
                at += 1
                memory, made, decided = step(memory, row, at == row[total])
                decided = decided or at == row[total]
                out.extend(key + tuple(m) for m in made)
            if decided:
                memory, early = None, {}
        state.update((pickle.dumps((memory, at, early, decided)),))
        if decided and forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        if out:
            yield pd.DataFrame(out, columns=columns)

    ship(stream.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(fold, output, STATE, "append", timeout)
