"""Token budgets of one call, as column expressions over token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _floor0(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), c)


def call_budget(total: Column, surface: Column, *, window: int, reserve: int, margin: int, injected: int = 0, instruction: int, checkpoint: int, tail: int, tail_min: int) -> Column:
    """Envelope, room for history, tail to retain and the cap of one batch; dominated if no batch fits."""
    envelope = _floor0(total - surface)
    room = _floor0(window - envelope - reserve - margin - injected)
    kept = F.greatest(F.lit(tail_min).cast("long"), F.least(room, F.lit(tail).cast("long")))
    cap = _floor0(room - instruction - checkpoint)
    return F.struct(envelope.alias("envelope"), room.alias("room"), kept.alias("tail"), cap.alias("cap"), (cap <= 0).alias("dominated"))


def zone_budget(total: Column, surface: Column, *, waterline: int, pressure: int, injected: int = 0, forget: int, tail: int, tail_min: int) -> Column:
    """Room under the waterline, boundaries of the zones, what is over, and whether the envelope alone makes pressure."""
    envelope = _floor0(total - surface)
    room = _floor0(waterline - envelope - injected)
    kept = F.greatest(F.lit(tail_min).cast("long"), F.least(room, F.lit(tail).cast("long")))
    return F.struct(
        envelope.alias("envelope"),
        room.alias("room"),
        F.least(F.lit(forget).cast("long"), room).alias("forget"),
        kept.alias("tail"),
        _floor0(surface - room).alias("deficit"),
        (envelope + injected + kept >= pressure).alias("dominated"),
    )


def low_yield(before: Column, after: Column, span: Column, *, floor_tokens: int = 1024, floor_ratio: float = 0.15) -> Column:
    """What one batch released: `no-progress`, `low-yield` or `ok`; the ratio is of the span, 0 for an empty one."""
    released = before - after
    ratio = F.when(span > 0, released / span).otherwise(0.0)
    return F.when(after >= before, "no-progress").when((released < floor_tokens) & (ratio < floor_ratio), "low-yield").otherwise("ok")
