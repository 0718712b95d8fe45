"""Folds of a session that never overlap: one at a time, and what may follow it.

A fold is started by a backlog at start-up, by a threshold of waiting events, at once by an authority fact, or by hand; what
comes while one runs is never put beside it, only noted. A fold that ends well may be followed by one more (`trailing`, or `urgent`
where a fact that came meanwhile is still outstanding), and a following fold by none but for a new threshold or a new fact. One that
fails, or never reports within `patience`, is followed by nothing; what waits stays until more comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What comes in: `event` (seq, urgent), `hydrated`, `manual`, and `settled` (flight, committed, seq: the cursor that it reached).
SIGNAL = "session_id long, arrival long, signal string, seq long, urgent boolean, flight long, committed boolean"
LAUNCH = "session_id long, flight long, trigger string, n long, first_seq long, window_end long"
STATE = "counted long, flight long, running string, started boolean, wanted boolean, urgent_wanted boolean, urgent_through long, deferred long, pending array<long>"


class Limits(NamedTuple):
    """Events that start a fold, the most of one fold, and milliseconds after which a silent fold counts as failed."""

    least: int = 20
    most: int = 200
    patience: int = 120_000


class Flight:
    """The schedule of one session; each call gives the launch that it causes, if any."""

    def __init__(self, limits: Limits, state: tuple | None = None) -> None:
        fresh = (-1, 0, None, False, False, False, -1, -1, [])
        self.limits = limits
        self.counted, self.flight, self.running, self.started, self.wanted, self.urgent_wanted, self.urgent_through, self.deferred, pending = state or fresh
        self.pending = list(pending)

    def state(self) -> tuple:
        return (self.counted, self.flight, self.running, self.started, self.wanted, self.urgent_wanted, self.urgent_through, self.deferred, self.pending)

    def _launch(self, trigger: str) -> tuple | None:
        if self.running or not self.pending:
            return None
        window = self.pending[: self.limits.most]
        self.flight, self.running = self.flight + 1, trigger
        return self.flight, trigger, len(window), window[0], window[-1]

    def event(self, seq: int, urgent: bool) -> tuple | None:
        """An eligible event; what is at or below the last one counted is a replay."""
        if seq > self.counted:
            self.counted = seq
            self.pending.append(seq)
        if urgent and seq > self.urgent_through and self.pending:
            self.urgent_through = seq
            if not self.running:
                self.deferred = -1
                return self._launch("urgent")
            self.deferred, self.wanted, self.urgent_wanted = seq, True, True
        if len(self.pending) >= self.limits.least:
            if self.running:
                self.wanted = True
            return self._launch("threshold")
        return None

    def hydrated(self) -> tuple | None:
        """The session is there again: its backlog is looked at once."""
        if self.started:
            return None
        self.started = True
        if len(self.pending) < self.limits.least:
            return None
        self.wanted |= bool(self.running)
        return self._launch("startup")

    def manual(self) -> tuple | None:
        self.wanted |= bool(self.running)
        return self._launch("manual")

    def settled(self, flight: int, committed: bool, cursor: int | None) -> tuple | None:
        """A fold has ended; reports of any other fold than the one that runs are late and say nothing."""
        if not self.running or flight != self.flight:
            return None
        kind, self.running = self.running, None
        if not committed:
            return None
        self.pending = [s for s in self.pending if cursor is None or s > cursor]
        outstanding = cursor is not None and self.deferred > cursor
        urgent, self.urgent_wanted = self.urgent_wanted and outstanding, False
        if outstanding:
            self.deferred = -1
        full = len(self.pending) >= self.limits.least
        if kind in ("trailing", "urgent"):
            return self._launch("threshold") if full else self._launch("urgent") if urgent else None
        follow, self.wanted = self.wanted or full, False
        return self._launch("urgent" if urgent else "trailing") if follow else None


def single_flights(signals: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """LAUNCH rows from a stream of SIGNAL rows, which are taken in order of arrival within a session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Flight(limits, state.get if state.exists else None)
        rows = []
        if state.hasTimedOut:
            own.settled(own.flight, False, None)
        else:
            for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
                seq = None if pd.isna(r.seq) else int(r.seq)
                if r.signal == "event":
                    made = own.event(seq, bool(r.urgent))
                elif r.signal == "settled":
                    made = own.settled(int(r.flight), bool(r.committed), seq)
                else:
                    made = own.hydrated() if r.signal == "hydrated" else own.manual() if r.signal == "manual" else None
                if made:
                    rows.append((key[0], *made))
        state.update(own.state())
        if own.running:
            state.setTimeoutDuration(limits.patience)
        yield pd.DataFrame(rows, columns=["session_id", "flight", "trigger", "n", "first_seq", "window_end"])

    return signals.groupBy("session_id").applyInPandasWithState(step, LAUNCH, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
