"""Cuts, zones and batches over the surface of each session.

All of it comes from one window over (session_id, pos): prefix sums forwards, and suffix sums as total minus prefix, so that
Spark sorts a session once. A session is one window partition; its order is global, so it can't be salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_pos() -> WindowSpec:
    """Each session in the order of its surface."""
    return Window.partitionBy("session_id").orderBy("pos")


def whole() -> WindowSpec:
    """Each session as one frame."""
    return Window.partitionBy("session_id")


def with_cuts(surface: DataFrame) -> DataFrame:
    """Adds open calls before and after each node, whether a cut there is safe, and the tokens up to it.

    A cut is safe where no call waits for its result and no step (turn and step both known and equal) is parted. Pairing goes
    by counts, not by call ids.
    """
    delta = F.when(F.col("type") == "assistant/message", F.col("tool_calls")).when(F.col("type") == "tool/result", -1).otherwise(0).cast("long")
    upto = by_pos().rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(delta).over(upto)
    same_step = F.coalesce((F.lead("turn").over(by_pos()) == F.col("turn")) & (F.lead("step").over(by_pos()) == F.col("step")), F.lit(False))
    rows = surface.withColumns(
        {
            "delta": delta,
            "open_after": after,
            "open_before": after - delta,
            "step_end": ~same_step,
            "upto": F.sum("tokens").over(upto),
            "total": F.sum("tokens").over(whole()),
            "nodes": F.count("*").over(whole()),
        }
    )
    rows = rows.withColumn("safe_end", (F.col("open_after") == 0) & F.col("step_end"))
    before = F.coalesce(F.lag("step_end").over(by_pos()), F.lit(True))
    return rows.withColumn("safe_start", (F.col("open_before") == 0) & before)


def pairing_balance(surface: DataFrame) -> DataFrame:
    """(session_id, pos, open_before, open_after, corrupt): corrupt sessions once had more results than calls."""
    rows = with_cuts(surface)
    return rows.select("session_id", "pos", "open_before", "open_after", (F.min("open_after").over(whole()) < 0).alias("corrupt"))


def tail_start(cuts: DataFrame, boundary: Column | int, name: str, step_checked: bool = True) -> DataFrame:
    """Adds the position where the tail of at least `boundary` tokens starts, moved back to a safe cut; the surface's end if the boundary isn't positive."""
    boundary = F.lit(boundary) if isinstance(boundary, int) else boundary
    suffix = F.col("total") - F.col("upto") + F.col("tokens")
    raw = F.coalesce(F.max(F.when(suffix >= boundary, F.col("pos"))).over(whole()), F.lit(0).cast("long"))
    safe = F.col("safe_start") if step_checked else F.col("open_before") == 0
    rows = cuts.withColumn("_raw", raw)
    moved = F.coalesce(F.max(F.when(safe & (F.col("pos") <= F.col("_raw")), F.col("pos"))).over(whole()), F.lit(0).cast("long"))
    return rows.withColumn(name, F.when(boundary <= 0, F.col("nodes")).otherwise(moved)).drop("_raw")


def with_zones(cuts: DataFrame, recent: Column | int, forget: Column | int) -> DataFrame:
    """Adds recent_start, forget_start and the zone of each node: forget, tool, recent from the oldest on."""
    rows = tail_start(tail_start(cuts, recent, "recent_start"), forget, "_forget")
    rows = rows.withColumn("forget_start", F.least("recent_start", "_forget")).drop("_forget")
    zone = F.when(F.col("pos") >= F.col("recent_start"), "recent").when(F.col("pos") >= F.col("forget_start"), "tool").otherwise("forget")
    return rows.withColumn("zone", zone)


def zone_totals(zoned: DataFrame) -> DataFrame:
    """(session_id, zone, n, tokens, first_pos, last_pos)."""
    return zoned.groupBy("session_id", "zone").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


def forget_batch(zoned: DataFrame, target: int = 16_000, most: int = 24_000) -> DataFrame:
    """(session_id, end_pos, tokens, reason): the oldest batch of the forget zone that ends at a safe cut, or why there is none."""
    target = max(1, target)
    most = max(target, most)
    inside = (F.col("zone") == "forget") & F.col("safe_end")
    found = zoned.groupBy("session_id").agg(
        F.count_if(F.col("zone") == "forget").alias("n"),
        F.max(F.when(F.col("pos") == 0, F.col("open_before"))).alias("first"),
        F.count_if(inside).alias("ends"),
        F.min(F.when(inside & F.col("upto").between(target, most), F.struct("pos", "upto"))).alias("full"),
        F.max(F.when(inside & (F.col("upto") <= most), F.struct("pos", "upto"))).alias("widest"),
    )
    chosen = F.coalesce("full", "widest")
    reason = (
        F.when(F.col("n") == 0, "no-forget-range")
        .when(F.col("first") != 0, "unsafe-forget-start")
        .when(chosen.isNotNull(), F.lit(None))
        .when(F.col("ends") > 0, "oldest-unit-too-large")
        .otherwise("no-safe-batch-end")
    )
    return found.select("session_id", chosen["pos"].alias("end_pos"), chosen["upto"].alias("tokens"), reason.alias("reason"))


def pressure_span(zoned: DataFrame, *, reclaim: int, cap: Column | int, least: int = 0, min_start: int = 0, max_end: Column | None = None) -> DataFrame:
    """(session_id, start_pos, end_pos, tokens, reason): the span before the recent zone that ends pressure, or the widest under the cap."""
    cap = F.lit(max(0, cap)) if isinstance(cap, int) else F.greatest(F.lit(0), cap)
    head = F.col("recent_start") - 1 if max_end is None else F.least(F.col("recent_start") - 1, max_end)
    rows = zoned.withColumns({"_head": head, "_cap": cap})
    start = F.min(F.when((F.col("pos") >= min_start) & (F.col("safe_start") if min_start else F.col("open_before") == 0) & (F.col("pos") <= F.col("_head")), F.col("pos"))).over(whole())
    rows = rows.withColumn("_start", start if min_start else F.when(F.max(F.when(F.col("pos") == 0, F.col("open_before"))).over(whole()) == 0, F.lit(0).cast("long")))
    skipped = F.coalesce(F.max(F.when(F.col("pos") < F.col("_start"), F.col("upto"))).over(whole()), F.lit(0).cast("long"))
    rows = rows.withColumn("_span", F.col("upto") - skipped)
    end = F.col("safe_end") & (F.col("pos") >= F.col("_start")) & (F.col("pos") <= F.col("_head")) & (F.col("_span") <= F.col("_cap"))
    found = rows.groupBy("session_id").agg(
        F.max("_cap").alias("cap"),
        F.max("_start").alias("start"),
        F.min(F.when(end & (F.col("_span") >= reclaim + least + 1), F.struct("pos", "_span"))).alias("sized"),
        F.max(F.when(end, F.struct("pos", "_span"))).alias("widest"),
    )
    chosen = F.coalesce("sized", "widest")
    reason = F.when(F.col("cap") <= 0, "envelope-dominated").when(chosen.isNull(), "no-safe-prefix").when(chosen["_span"] <= least, "span-below-minimum")
    good = reason.isNull()
    return found.select(
        "session_id", F.when(good, F.col("start")).alias("start_pos"), F.when(good, chosen["pos"]).alias("end_pos"), F.when(good, chosen["_span"]).alias("tokens"), reason.alias("reason")
    )


def retained_tail_floor(surface: DataFrame, log: DataFrame, turns: int = 2) -> DataFrame:
    """(session_id, tokens): the newest nodes up to, not with, the first of a further turn once `turns` turns, the open one and the last completed one were met."""
    edges = log.where(F.col("type").isin("turn/start", "turn/end")).groupBy("session_id").agg(
        F.max_by(F.struct("type", "turn"), "seq").alias("edge"),
        F.max_by("turn", F.when((F.col("type") == "turn/end") & (F.col("reason") == "completed"), F.col("seq"))).alias("completed"),
    )
    rows = surface.join(edges.select("session_id", F.when(F.col("edge.type") == "turn/start", F.col("edge.turn")).alias("opened"), "completed"), "session_id", "left")
    newest = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    first = F.col("turn").isNotNull() & (F.row_number().over(Window.partitionBy("session_id", "turn").orderBy(F.desc("pos"))) == 1)
    before = newest.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_new", first)
    met = lambda turn: F.col(turn).isNull() | F.coalesce(F.max(F.col("turn") == F.col(turn)).over(before), F.lit(False))
    stop = F.col("_new") & (F.coalesce(F.count_if("_new").over(before), F.lit(0)) >= turns) & met("opened") & met("completed")
    rows = rows.withColumn("_stop", stop)
    cut = F.max(F.when(F.col("_stop"), F.col("pos"))).over(whole())
    return rows.withColumn("_cut", F.coalesce(cut, F.lit(-1))).groupBy("session_id").agg(F.coalesce(F.sum(F.when(F.col("pos") > F.col("_cut"), F.col("tokens"))), F.lit(0)).alias("tokens"))
