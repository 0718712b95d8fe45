"""The log as a stream: windows of eligible events by count, as they fill up.

There is no event time here: a session's watermark is the highest seq seen, and windows are cut by count, not by clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = "session_id long, trigger string, n long, first_seq long, source_cursor long"
STATE = "counted_through long, cursor long, pending array<long>"


def counted_folds(events: DataFrame, least: int = 20, most: int = 200, urgent: tuple[str, ...] = ("todo/write",)) -> DataFrame:
    """WINDOW rows from a stream of (session_id, seq, type): a window once `least` events wait, at most `most` in one, or at once when
    an urgent event comes. Events at or below what was counted are replays and change nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counted, cursor, pending = state.get if state.exists else (-1, -1, [])
        pending, rows = list(pending), []
        fresh = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        for seq, kind in zip(fresh["seq"].tolist(), fresh["type"].tolist(), strict=True):
            if seq <= counted:
                continue
            counted = seq
            pending.append(seq)
            trigger = "urgent" if kind in urgent else "threshold" if len(pending) >= least else None
            while trigger and pending:
                window, pending = pending[:most], pending[most:]
                cursor = window[-1]
                rows.append((key[0], trigger, len(window), window[0], cursor))
        state.update((counted, cursor, pending))
        yield pd.DataFrame(rows, columns=["session_id", "trigger", "n", "first_seq", "source_cursor"])

    return events.groupBy("session_id").applyInPandasWithState(fold, WINDOW, STATE, "append", GroupStateTimeout.NoTimeout)
