"""The pressure loop: spans of the oldest history are replaced by summaries until a session is below its exit line.

Every round plans all sessions at once, so the rounds are as many as the policy allows batches, whatever the number of sessions.
The summaries' prices are an input: text that a model wrote is never made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.files import settled
from loomstrand.functions.budgets import low_yield
from loomstrand.operators.zones import with_cuts, with_zones
from loomstrand.plans.config import Spec


def _replaced(surface: DataFrame, spans: DataFrame, price: Column) -> DataFrame:
    """Surfaces after each span gave way to one summary node, which takes the place of the first."""
    rows = surface.join(spans.select("session_id", "start_pos", "end_pos", "span_tokens"), "session_id", "left")
    inside = F.coalesce(F.col("pos").between(F.col("start_pos"), F.col("end_pos")), F.lit(False))
    first = inside & (F.col("pos") == F.col("start_pos"))
    none = F.lit(None).cast("long")
    swap = lambda c, v: F.when(first, v).otherwise(F.col(c))
    rows = rows.where(~inside | first).select(
        "session_id", "pos", "seq", swap("type", F.lit("user/message")).alias("type"), swap("turn", none).alias("turn"), swap("step", none).alias("step"),
        swap("tool_calls", F.lit(0).cast("long")).alias("tool_calls"), swap("tokens", price).cast("long").alias("tokens"), swap("summary", F.lit(True)).alias("summary"),
    )
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("pos")).cast("long") - 1)


def pressure_ledger(surface: DataFrame, spec: Spec, cap: int, price: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger, outcomes) of one pass over (session_id, pos, seq, type, turn, step, tool_calls, tokens).

    `price`: tokens of the summary of a span of span_tokens, a tenth and 50 more unless given. A batch starts after the
    summaries that this pass made. Low-yield batches and batches without progress end a session's pass.
    """
    price = F.floor(F.col("span_tokens") / 10) + 50 if price is None else price
    policy = spec.policy
    now = settled(surface.select("session_id", "pos", "seq", "type", "turn", "step", "tool_calls", "tokens", F.lit(False).alias("summary")))
    total = now.groupBy("session_id").agg(F.sum("tokens").alias("total"))
    state = settled(total.where(F.col("total") >= spec.threshold).withColumn("reason", F.lit(None).cast("string")))
    ledger: DataFrame | None = None
    for batch in range(1, policy.max_pressure_batches + 1):
        active = state.where((F.col("total") > spec.exit) & F.col("reason").isNull())
        zoned = with_zones(with_cuts(now.join(active.select("session_id", "total").withColumnRenamed("total", "_all"), "session_id")), spec.retain, spec.forget)
        led = F.coalesce(F.min(F.when(~F.col("summary"), F.col("pos"))).over(Window.partitionBy("session_id")), F.col("nodes"))
        zoned = zoned.withColumn("_from", led).where(F.col("pos") >= F.col("_from"))
        skipped = F.coalesce(F.min(F.col("upto") - F.col("tokens")).over(Window.partitionBy("session_id")), F.lit(0))
        zoned = zoned.withColumn("_shift", skipped).withColumns({"upto": F.col("upto") - F.col("_shift")})
        plans = _plans(zoned, spec, cap)
        spans = plans.where("reason is null").withColumnRenamed("tokens", "span_tokens")
        now = settled(_replaced(now, spans, price))
        after = now.groupBy("session_id").agg(F.sum("tokens").alias("after_tokens"))
        done = spans.join(state.select("session_id", F.col("total").alias("before_tokens")), "session_id").join(after, "session_id")
        verdict = low_yield(F.col("before_tokens"), F.col("after_tokens"), F.col("span_tokens"), floor_tokens=policy.min_net_release_tokens, floor_ratio=policy.min_net_release_ratio)
        done = settled(done.select("session_id", F.lit(batch).alias("batch"), "start_pos", "end_pos", "span_tokens", "before_tokens", "after_tokens", verdict.alias("verdict")))
        ledger = done if ledger is None else ledger.unionByName(done)
        blocked = plans.where("reason is not null").select("session_id", F.col("reason").alias("_blocked"))
        moved = state.join(done.select("session_id", "after_tokens", "verdict"), "session_id", "left").join(blocked, "session_id", "left")
        reason = F.coalesce("reason", "_blocked", F.when(F.col("verdict") != "ok", F.col("verdict")))
        state = settled(moved.select("session_id", F.coalesce("after_tokens", "total").alias("total"), reason.alias("reason")))
        if not state.where((F.col("total") > spec.exit) & F.col("reason").isNull()).head(1):
            break
    outcome = F.when(F.col("total") <= spec.exit, "pressure-exit").otherwise(F.coalesce("reason", F.lit("batch-limit")))
    return ledger, state.select("session_id", "total", outcome.alias("outcome"))


def _plans(zoned: DataFrame, spec: Spec, cap: int) -> DataFrame:
    """Plans whose reclaim is each session's own excess over the exit line."""
    own = zoned.withColumn("_reclaim", F.greatest(F.lit(0), F.col("_all") - spec.exit))
    end = F.col("safe_end") & (F.col("pos") < F.col("recent_start")) & (F.col("upto") <= cap)
    found = own.groupBy("session_id").agg(
        F.min("pos").alias("start_pos"),
        F.min_by("open_before", "pos").alias("first"),
        F.min(F.when(end & (F.col("upto") >= F.col("_reclaim") + 1), F.struct("pos", "upto"))).alias("sized"),
        F.max(F.when(end, F.struct("pos", "upto"))).alias("widest"),
    )
    chosen = F.coalesce("sized", "widest")
    reason = F.when(F.lit(cap <= 0), "envelope-dominated").when((F.col("first") != 0) | chosen.isNull(), "no-safe-prefix")
    return found.select("session_id", "start_pos", chosen["pos"].alias("end_pos"), chosen["upto"].alias("tokens"), reason.alias("reason"))


def maintenance(zoned: DataFrame, spec: Spec) -> DataFrame:
    """(session_id, tier): nothing, tool stages, one oldest-first batch, or pressure, by a session's total tokens."""
    total = zoned.groupBy("session_id").agg(F.sum("tokens").alias("total"))
    tier = F.when(F.col("total") >= spec.threshold, "pressure").when(F.col("total") >= spec.forget_line, "forget").when(F.col("total") >= spec.tool_line, "tools").otherwise("none")
    return total.select("session_id", "total", tier.alias("tier"))


def ledger_snapshot(surface: DataFrame, slots: DataFrame, generations: DataFrame, spec: Spec) -> DataFrame:
    """(session_id, generation, before_tokens, after_tokens, threshold, exit, exit_reached, injection_tokens): where every session stands,
    without a pass. `slots`: (session_id, injection_tokens); `generations`: (session_id, generation)."""
    stop = min(spec.threshold, spec.exit)
    rows = surface.groupBy("session_id").agg(F.sum("tokens").alias("total")).join(slots, "session_id", "left").join(generations, "session_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "session_id", F.coalesce("generation", zero).alias("generation"), F.col("total").alias("before_tokens"), F.col("total").alias("after_tokens"), F.lit(spec.threshold).cast("long").alias("threshold"),
        F.lit(stop).cast("long").alias("exit"), (F.col("total") <= stop).alias("exit_reached"), F.coalesce("injection_tokens", zero).alias("injection_tokens"),
    )
