"""Tool segments and groups: runs of calls and results of one turn that may be summarised together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.operators.zones import by_pos

LEAST_RESULTS, LEAST_CHARS, LEAST_TOKENS, MOST_TOKENS, MOST_GROUPS = 2, 12_000, 2_000, 12_000, 2


def with_segments(cuts: DataFrame) -> DataFrame:
    """The nodes of tool segments, with the segment's number in its session.

    A segment is the longest run of tool calls and results of one turn, without results that lead it, from its first balanced
    cut to its last.
    """
    burst = ((F.col("type") == "assistant/message") & (F.col("tool_calls") > 0)) | (F.col("type") == "tool/result")
    rows = cuts.withColumn("_burst", burst)
    joined = F.coalesce(F.lag("_burst").over(by_pos()), F.lit(False)) & F.coalesce(F.lag("turn").over(by_pos()).eqNullSafe(F.col("turn")), F.lit(False))
    rows = rows.withColumn("_breaks", F.col("_burst") & ~joined)
    rows = rows.withColumn("_island", F.sum(F.col("_breaks").cast("long")).over(by_pos().rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("session_id", "_island")
    rows = rows.where("_burst").withColumn("_call", F.min(F.when(F.col("type") == "assistant/message", F.col("pos"))).over(island))
    rows = rows.where(F.col("pos") >= F.col("_call"))
    rows = rows.withColumn("_first", F.min(F.when(F.col("open_before") == 0, F.col("pos"))).over(island))
    rows = rows.withColumn("_last", F.max(F.when(F.col("open_after") == 0, F.col("pos"))).over(island))
    rows = rows.where((F.col("_last") > F.col("_first")) & F.col("pos").between(F.col("_first"), F.col("_last")))
    return rows.withColumnRenamed("_island", "segment").drop("_burst", "_breaks", "_call", "_first", "_last")


def totals(nodes: DataFrame, *keys: str) -> DataFrame:
    """What thresholds ask for: first and last position, nodes, results, their characters, tokens."""
    result = F.col("type") == "tool/result"
    return nodes.groupBy("session_id", *keys).agg(
        F.min("pos").alias("start_pos"),
        F.max("pos").alias("end_pos"),
        F.count("*").alias("n"),
        F.count_if(result).alias("results"),
        F.coalesce(F.sum(F.when(result, F.col("chars"))), F.lit(0)).alias("chars"),
        F.sum("tokens").alias("tokens"),
    )


def passes(least_results: int = LEAST_RESULTS, least_chars: int = LEAST_CHARS, least_tokens: int = LEAST_TOKENS) -> Column:
    """The thresholds that a segment must meet before it is cut, and a group after."""
    return (F.col("results") >= least_results) & (F.col("chars") >= least_chars) & (F.col("tokens") >= least_tokens)


def with_chunks(segments: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Adds the number of the chunk: as many atoms between safe cuts as fit into `most_tokens`, an oversized atom alone.

    Where a chunk begins depends on all before it, so a fold runs over each segment's atoms.
    """
    by_pos = Window.partitionBy("session_id", "segment").orderBy("pos")
    atom = F.coalesce(F.sum(F.col("safe_end").cast("long")).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = segments.withColumn("atom", atom)
    atoms = rows.groupBy("session_id", "segment", "atom").agg(F.sum("tokens").alias("tokens"))
    listed = atoms.groupBy("session_id", "segment").agg(F.sort_array(F.collect_list(F.struct("atom", "tokens"))).alias("atoms"))
    empty = F.struct(F.array().cast("array<bigint>").alias("chunks"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("chunk"))

    def step(state: Column, item: Column) -> Column:
        fresh = (F.size(state["chunks"]) > 0) & (state["held"] + item["tokens"] > most_tokens)
        chunk = F.when(fresh, state["chunk"] + 1).otherwise(state["chunk"])
        held = F.when(fresh, item["tokens"]).otherwise(state["held"] + item["tokens"])
        return F.struct(F.array_append(state["chunks"], chunk).alias("chunks"), held.alias("held"), chunk.alias("chunk"))

    folded = listed.select("session_id", "segment", F.posexplode(F.aggregate("atoms", empty, step, lambda s: s["chunks"])).alias("atom", "chunk"))
    return rows.join(folded.withColumn("atom", F.col("atom").cast("long")), ["session_id", "segment", "atom"])


def tool_groups(zoned: DataFrame, most_tokens: int = MOST_TOKENS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """(session_id, segment, chunk, start_pos, end_pos, n, results, chars, tokens): the first groups of each session that pass.

    Only segments wholly before the recent zone count. Whole segments must pass before oversized ones are cut into chunks,
    and each chunk must pass again.
    """
    nodes = with_segments(zoned)
    whole = Window.partitionBy("session_id", "segment")
    result = F.col("type") == "tool/result"
    nodes = nodes.withColumns(
        {
            "results": F.count_if(result).over(whole),
            "_chars": F.coalesce(F.sum(F.when(result, F.col("chars"))).over(whole), F.lit(0)),
            "_tokens": F.sum("tokens").over(whole),
            "_end": F.max("pos").over(whole),
        }
    )
    good = (F.col("results") >= LEAST_RESULTS) & (F.col("_chars") >= LEAST_CHARS) & (F.col("_tokens") >= LEAST_TOKENS) & (F.col("_end") < F.col("recent_start"))
    chunked = with_chunks(nodes.where(good), most_tokens)
    groups = totals(chunked, "segment", "chunk").where(passes() & (F.col("tokens") <= most_tokens))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("start_pos"))
    return groups.withColumn("_rank", rank).where(F.col("_rank") <= most_groups).drop("_rank")


def eligible_spans(nodes: DataFrame) -> DataFrame:
    """(session_id, segment, start_pos, end_pos): parts of segments whose results are all `eligible` (a column of `nodes`).

    Where eligibility changes the segment is cut at the latest safe cut after the last result of the other kind; without such
    a cut the sides stay together, and a part that mixes both is left out.

    Only results with a safe cut since the result before them can be cut off. Whether one is or not, what counts from it on is its
    own eligibility: so it is cut off exactly if the newest such result before it (or the first of all) was of the other kind.
    """
    own = Window.partitionBy("session_id", "segment").orderBy("pos")
    before, onward = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    result = F.col("type") == "tool/result"
    rows = nodes.select("session_id", "segment", "pos", "safe_end", result.alias("_result"), "eligible", F.row_number().over(own).alias("_i"))
    rows = rows.withColumns({"_last": F.max(F.when(F.col("_result"), F.col("_i"))).over(before), "_safe": F.max(F.when(F.col("safe_end"), F.col("_i"))).over(before)})
    rows = rows.withColumn("_free", F.col("_result") & (F.col("_last").isNull() | F.coalesce(F.col("_safe") >= F.col("_last"), F.lit(False))))
    kind = F.last(F.when(F.col("_free"), F.col("eligible")), ignorenulls=True).over(before)
    cut = F.when(F.col("_free") & F.col("_last").isNotNull() & (F.col("eligible") != kind), F.col("_safe") + 1)
    rows = rows.withColumn("_cut", F.when(F.col("_result"), F.struct(cut.alias("at"))))
    starts = F.coalesce(F.first("_cut", ignorenulls=True).over(onward)["at"] == F.col("_i"), F.lit(False))
    rows = rows.withColumn("_starts", starts.cast("int"))
    rows = rows.withColumn("_part", F.sum("_starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("session_id", "segment", "_part").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.bool_and(~F.col("_result") | F.col("eligible")).alias("_good"))
    return parts.where("_good").select("session_id", "segment", "start_pos", "end_pos")


def segment_owners(nodes: DataFrame, surface: DataFrame, asked: DataFrame) -> DataFrame:
    """(session_id, seq, first_seq, reason) of asked (session_id, seq): the first node of the segment that owns a node, null where none
    does; what isn't on the surface has a reason instead."""
    own = nodes.select("session_id", "seq", F.first("seq").over(Window.partitionBy("session_id", "segment").orderBy("pos")).alias("first_seq"))
    shown = surface.select("session_id", "seq", F.lit(True).alias("_shown"))
    rows = asked.select("session_id", "seq").join(own, ["session_id", "seq"], "left").join(shown, ["session_id", "seq"], "left")
    return rows.select("session_id", "seq", "first_seq", F.when(F.col("_shown").isNull(), "not-on-surface").alias("reason"))
