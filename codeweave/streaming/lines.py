"""Line-level connections of a stream (an addition: the batch operators have no streaming twin elsewhere).

Each conversation keeps the codes of its last ``back - 1`` lines as state; a line is counted when it
arrives, so that batches must bring a conversation's lines in order.  State of a conversation goes
when it has been idle for ``idle`` (processing time), if given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import layout as L
from ..model import CONVERSATION, UNIT
from ..operators.accumulate import composite
from ..plans.linalg import col, quoted


def stream_lines(df: DataFrame, units: Sequence[str], conversation: Sequence[str], codes: Sequence[str], order: str, back: int = 4, binary: bool = True, idle_ms: int | None = None) -> DataFrame:
    """``ENA_UNIT``, ``ENA_CONV``, the order column and the connections of each line, in append mode."""
    names, pairs = L.pair_names(codes), L.index_pairs(len(codes))
    kind = dict(df.dtypes)[order]
    rows = df.select(composite(units).alias(UNIT), composite(conversation).alias(CONVERSATION), col(order), *[col(c).cast("double").alias(c) for c in codes])
    schema = f"{UNIT} string, {CONVERSATION} string, {quoted(order)} {kind}, " + ", ".join(f"{quoted(n)} double" for n in names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values(order, kind="stable")
        c = new[list(codes)].to_numpy(float)
        held = np.array(state.get[0], float).reshape(-1, len(codes)) if state.exists else np.zeros((0, len(codes)))
        all_ = np.vstack([held, c])
        total = np.vstack([np.zeros(len(codes)), all_.cumsum(0)])
        at = np.arange(len(held), len(all_))
        h = total[at] - total[np.maximum(0, at - (back - 1))]
        value = np.column_stack([c[:, i] * c[:, j] + c[:, i] * h[:, j] + h[:, i] * c[:, j] for i, j in pairs]) if pairs else np.zeros((len(c), 0))
        out = pd.DataFrame((value > 0).astype(float) if binary else value, columns=names, index=new.index)
        keep = all_[len(all_) - min(len(all_), back - 1) :] if back > 1 else all_[:0]
        state.update((keep.ravel().tolist(),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.concat([new[[UNIT, CONVERSATION, order]], out], axis=1)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(F.col(CONVERSATION)).applyInPandasWithState(step, schema, "held array<double>", "append", timeout)
