"""Checks and ranges over surfaces, and what waits above a cursor. Nothing is raised: what is wrong comes back as rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstrand.operators.events import ELIGIBLE, kept_events


def misaligned(surface: DataFrame, prices: DataFrame) -> DataFrame:
    """(session_id, seq, reason): nodes without exactly one price, and prices of what isn't on the surface."""
    priced = prices.groupBy("session_id", "seq").agg(F.count("*").alias("n"))
    both = surface.select("session_id", "seq", F.lit(True).alias("shown")).join(priced, ["session_id", "seq"], "full")
    reason = F.when(F.col("n").isNull(), "unpriced").when(F.col("shown").isNull(), "not-on-surface").when(F.col("n") > 1, "priced-twice")
    return both.select("session_id", "seq", reason.alias("reason")).where("reason is not null")


def missing_events(surface: DataFrame, log: DataFrame) -> DataFrame:
    """(session_id, seq) of nodes whose event isn't in the log: a corrupt surface."""
    return surface.select("session_id", "seq").join(log.select("session_id", "seq"), ["session_id", "seq"], "left_anti")


def ranges(surface: DataFrame, asked: DataFrame) -> DataFrame:
    """(session_id, range_id, start_seq, end_seq, tokens) of position ranges (session_id, range_id, first, last); null if they leave the surface."""
    ends = surface.groupBy("session_id").agg(F.count("*").alias("nodes"))
    inside = asked.join(ends, "session_id").join(surface.select("session_id", "pos", "seq", "tokens"), "session_id").where(F.col("pos").between(F.col("first"), F.col("last")))
    found = inside.groupBy("session_id", "range_id", "first", "last", "nodes").agg(F.min_by("seq", "pos").alias("start_seq"), F.max_by("seq", "pos").alias("end_seq"), F.sum("tokens").alias("tokens"))
    good = (F.col("first") >= 0) & (F.col("last") < F.col("nodes"))
    kept = found.where(good).select("session_id", "range_id", "start_seq", "end_seq", "tokens")
    return asked.select("session_id", "range_id").join(kept, ["session_id", "range_id"], "left")


def span_reasons(cuts: DataFrame, asked: DataFrame) -> DataFrame:
    """(session_id, range_id, reason) of spans (session_id, range_id, start_seq, end_seq): null for those that may be replaced."""
    node = lambda name: cuts.select("session_id", F.col("seq").alias(f"{name}_seq"), F.col("pos").alias(f"_{name}"), F.col("open_before").alias(f"_{name}_before"), F.col("open_after").alias(f"_{name}_after"))
    rows = asked.join(node("start"), ["session_id", "start_seq"], "left").join(node("end"), ["session_id", "end_seq"], "left")
    reason = (
        F.when(F.col("_start").isNull(), "start-not-on-surface")
        .when(F.col("_end").isNull(), "end-not-on-surface")
        .when(F.col("_start") > F.col("_end"), "reversed")
        .when(F.col("_start_before") != 0, "open-before-start")
        .when(F.col("_end_after") != 0, "open-after-end")
    )
    return rows.select("session_id", "range_id", reason.alias("reason"))


def in_older_range(mode: Column, pos: Column, first: Column, last: Column) -> Column:
    """Three states of a range: `all` is the whole surface, `none` nothing, `range` the closed interval; a null mode is none."""
    return F.coalesce((mode == "all") | ((mode == "range") & pos.between(first, last)), F.lit(False))


def backlog(log: DataFrame, cursors: DataFrame, slot_kind: str = "slot") -> DataFrame:
    """(session_id, waiting, high_water) for logs of (session_id, seq, type, data).

    What waits are events above the cursor of which the projection keeps something. The high water is the newest seq of an
    eligible type, whatever it says, but for messages of a slot itself; 0 without any.
    """
    waiting = kept_events(log).join(cursors, "session_id").where(F.col("seq") > F.col("cursor")).groupBy("session_id").agg(F.count("*").alias("waiting"))
    slot = (F.col("type") == "user/message") & (F.coalesce(F.get_json_object("data", "$.source.kind"), F.lit("")) == slot_kind)
    newest = log.where(F.col("type").isin(*ELIGIBLE) & ~slot).groupBy("session_id").agg(F.max("seq").alias("high_water"))
    rows = cursors.select("session_id").join(waiting, "session_id", "left").join(newest, "session_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select("session_id", F.coalesce("waiting", zero).alias("waiting"), F.coalesce("high_water", zero).alias("high_water"))


def commit_fences(attempts: DataFrame, now: DataFrame) -> DataFrame:
    """(session_id, request_id, reason): null where generation and nodes are still those that the attempt was made for."""
    rows = attempts.join(now.select("session_id", F.col("generation").alias("_generation"), F.col("seqs").alias("_seqs")), "session_id", "left")
    reason = (
        F.when(F.col("_generation").isNull(), "session-changed").when(F.col("generation") != F.col("_generation"), "generation-changed").when(~F.col("seqs").eqNullSafe(F.col("_seqs")), "source-changed")
    )
    return rows.select("session_id", "request_id", reason.alias("reason"))


def terminal_verdicts(verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, accepted, reason) of verdicts (session_id, kind, cursor, generation) against (session_id, now, held, generation_now).

    A quarantine must move the cursor on; a block must not, must be of the current generation, and must not say again what is held.
    """
    rows = verdicts.join(records, "session_id")
    reason = (
        F.when(~F.col("kind").isin("quarantined", "block"), "unknown-kind")
        .when((F.col("kind") == "quarantined") & (F.col("cursor") <= F.col("now")), "cursor-not-advanced")
        .when((F.col("kind") == "block") & (F.col("cursor") != F.col("now")), "block-moves-cursor")
        .when((F.col("kind") == "block") & ~F.col("generation").eqNullSafe(F.col("generation_now")), "stale-generation")
        .when((F.col("kind") == "block") & F.col("held").eqNullSafe(F.col("generation")), "restated")
    )
    return rows.select("session_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """(session_id, batches, released, ratio): what a pass released in all, and per token of the spans that it paid for."""
    sums = ledger.groupBy("session_id").agg(F.count("*").alias("batches"), F.sum(F.col("before_tokens") - F.col("after_tokens")).alias("released"), F.sum("span_tokens").alias("_span"))
    return sums.select("session_id", "batches", "released", F.when(F.col("_span") > 0, F.col("released") / F.col("_span")).otherwise(0.0).alias("ratio"))


def newest_header_and_span(log: DataFrame, spans: DataFrame) -> DataFrame:
    """(session_id, header_seq, messages): the newest request header and a span's seqs in order, which a derived request starts with.

    `spans`: (session_id, pos, seq) of the span's nodes.
    """
    headers = log.where("type = 'request/header'").groupBy("session_id").agg(F.max("seq").alias("header_seq"))
    held = spans.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "seq"))), lambda s: s["seq"]).alias("messages"))
    return held.join(headers, "session_id", "left").select("session_id", "header_seq", "messages")
