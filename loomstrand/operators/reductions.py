"""Rows that reductions append to a log, and the guards that must pass before.

A replacement always comes right after the event that records what it shadows, so both get consecutive seqs above the log's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.functions.blocks import BLOCK, clipped, replaced, token_sum
from loomstrand.functions.rows import once
from loomstrand.functions.text import PRUNE_HEAD, PRUNE_MARKER, PRUNE_TAIL, PRUNE_THRESHOLD

APPENDED = ["session_id", "seq", "type", "covers", "tokens"]


def _pairs(chosen: DataFrame, ends: DataFrame, tokens: Column) -> DataFrame:
    """A prune event with the shadowed price, then the replacement with its own, for every chosen node in order of place."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")).cast("long") - 1
    rows = chosen.withColumn("_at", place).join(ends, "session_id").withColumn("_new", tokens)
    none = F.array().cast("array<bigint>")
    prune = F.struct((F.col("next_seq") + 2 * F.col("_at")).alias("seq"), F.lit("compaction/prune").alias("type"), none.alias("covers"), F.col("tokens").alias("tokens"))
    replacement = F.struct((F.col("next_seq") + 2 * F.col("_at") + 1).alias("seq"), F.lit("tool/result").alias("type"), F.array("seq").alias("covers"), F.col("_new").alias("tokens"))
    return rows.select("session_id", F.explode(F.array(prune, replacement)).alias("r")).select("session_id", "r.*")


def log_ends(log: DataFrame) -> DataFrame:
    """(session_id, next_seq): where each log goes on."""
    return log.groupBy("session_id").agg((F.max("seq") + 1).alias("next_seq"))


def prune_rows(zoned: DataFrame, ends: DataFrame, threshold: int = PRUNE_THRESHOLD, hard_limit: int = 2 * PRUNE_THRESHOLD, head: int = PRUNE_HEAD, tail: int = PRUNE_TAIL) -> DataFrame:
    """APPENDED rows of one prune pass: results over the threshold before the recent zone, over the hard limit within it."""
    if hard_limit < threshold or head + len(PRUNE_MARKER) + tail > threshold:
        raise ValueError("head, marker and tail must fit into the threshold, and it into the hard limit")
    limit = F.when(F.col("zone") == "recent", hard_limit).otherwise(threshold)
    chosen = zoned.where((F.col("type") == "tool/result") & (F.col("chars") > limit))
    return _pairs(chosen, ends, F.lit((head + len(PRUNE_MARKER) + tail + 3) // 4 + 8).cast("long"))


LANDED = [*APPENDED, "blocks"]


def _block_pairs(chosen: DataFrame, ends: DataFrame) -> DataFrame:
    """LANDED rows of chosen nodes (session_id, pos, seq, tokens, made): a prune event with the old price, then the node with its new blocks."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")).cast("long") - 1
    rows = chosen.withColumn("_at", place).join(ends, "session_id").withColumn("_seq", F.col("next_seq") + 2 * F.col("_at"))
    none = F.array().cast("array<bigint>")
    prune = F.struct(F.col("_seq").alias("seq"), F.lit("compaction/prune").alias("type"), none.alias("covers"), F.col("tokens").alias("tokens"), F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"))
    new = F.struct((F.col("_seq") + 1).alias("seq"), F.lit("tool/result").alias("type"), F.array("seq").alias("covers"), token_sum(F.col("made")).alias("tokens"), F.col("made").cast(f"array<{BLOCK}>").alias("blocks"))
    return rows.select("session_id", F.explode(F.array(prune, new)).alias("r")).select("session_id", "r.*")


def block_prunes(results: DataFrame, ends: DataFrame, threshold: int = PRUNE_THRESHOLD, hard_limit: int = 2 * PRUNE_THRESHOLD, head: int = PRUNE_HEAD, tail: int = PRUNE_TAIL) -> DataFrame:
    """LANDED rows of one prune pass over results (session_id, pos, seq, recent, blocks).

    A result's text counts as a whole, whatever blocks it stands in; recent ones are held against the hard limit. Null contents and
    those within their limit have no row.
    """
    blocks = F.col("blocks")
    limits = {False: threshold, True: hard_limit}
    made = {recent: clipped(blocks, limit, threshold, head, tail) for recent, limit in limits.items()}
    rows = once(results, made=F.when(F.col("recent"), made[True]).otherwise(made[False])).where("made is not null")
    return _block_pairs(once(rows, tokens=token_sum(blocks)), ends)


def block_summaries(results: DataFrame, summaries: DataFrame, ends: DataFrame) -> DataFrame:
    """LANDED rows of group summaries (session_id, seq, text) over results (session_id, pos, seq, blocks).

    Each text takes the place of what the result's blocks say, where that makes the message cheaper; results without text, without a
    tool-result block or without a summary stay as they are.
    """
    blocks = F.col("blocks")
    rows = results.join(summaries.select("session_id", "seq", F.col("text").alias("_summary")), ["session_id", "seq"]).where("_summary is not null")
    rows = once(rows, made=replaced(blocks, F.col("_summary")), tokens=token_sum(blocks)).where("made is not null")
    return _block_pairs(rows.where(token_sum(F.col("made")) < F.col("tokens")), ends)


def span_stability(spans: DataFrame, surface: DataFrame, whole: bool = False) -> DataFrame:
    """(session_id, stable): whether a surface (session_id, pos, seq) still shows what a span (session_id, covers, ...) was chosen from.

    The span's nodes must still stand side by side in their order; with `whole`, `covers` must be the whole surface.
    """
    nodes = surface.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "seq"))), lambda n: n["seq"]).alias("_now"))
    at = F.array_position("_now", F.get("covers", F.lit(0)))
    same = F.col("_now") == F.col("covers") if whole else (at > 0) & (F.slice("_now", F.greatest(at, F.lit(1)).cast("int"), F.size("covers")) == F.col("covers"))
    return spans.join(nodes, "session_id", "left").select("session_id", F.coalesce(same & (F.size("covers") > 0), F.lit(False)).alias("stable"))


def group_rows(nodes: DataFrame, prices: DataFrame, ends: DataFrame) -> DataFrame:
    """APPENDED rows of group summaries: each result by its own summary, where that is cheaper than what it shadows.

    `prices`: (session_id, seq, price). Calls of the group stay; results without text or without a summary stay too.
    """
    priced = nodes.where((F.col("type") == "tool/result") & (F.col("chars") > 0)).join(prices, ["session_id", "seq"])
    return _pairs(priced.where(F.col("price") < F.col("tokens")), ends, F.col("price"))


def region_rows(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """(session_id, seq, type, covers, error) of history summaries over `spans` (session_id, covers array, tokens, price).

    A summary must be cheaper than its span, and the span must be `stable` where that column is given (see `span_stability`): then
    start, summary, the replacing message and end are appended, else start and an end that holds the error.
    """
    fault = F.when(~F.col("stable"), "span-changed") if "stable" in spans.columns else F.lit(None).cast("string")
    rows = spans.join(ends, "session_id").withColumn("_fault", F.coalesce(fault, F.when(F.col("price") >= F.col("tokens"), "summary-not-smaller")))
    none = F.array().cast("array<bigint>")
    no_error = F.lit(None).cast("string")
    row = lambda at, kind, covers=none, error=no_error: F.struct((F.col("next_seq") + at).alias("seq"), F.lit(kind).alias("type"), covers.alias("covers"), error.alias("error"))
    good = F.array(row(0, "compaction/start"), row(1, "compaction/summary"), row(2, "user/message", F.col("covers")), row(3, "compaction/end"))
    bad = F.array(row(0, "compaction/start"), row(1, "compaction/end", none, F.col("_fault")))
    return rows.select("session_id", F.explode(F.when(F.col("_fault").isNull(), good).otherwise(bad)).alias("r")).select("session_id", "r.*")


def summary_text(summary: Column, facts: Column, files: Column, errors: Column, unresolved: Column, seq: Column) -> Column:
    """The text that stands in for a tool result."""
    some = lambda c, by: F.when(F.size(c) > 0, F.array_join(c, by)).otherwise("(none)")
    lines = [("", F.lit("[tool group summary]")), ("Result: ", summary), ("Facts: ", some(facts, "; ")), ("Files: ", some(files, ", ")), ("Errors: ", some(errors, "; ")), ("Unresolved: ", some(unresolved, "; ")), ("Source event: seq=", seq.cast("string")), ("", F.lit("[/tool group summary]"))]
    return F.concat_ws("\n", *[F.concat(F.lit(name), c) for name, c in lines])


def isolated_summary(kinds: DataFrame, first: str = "first_pos", last: str = "last_pos") -> DataFrame:
    """(session_id, isolated): whether a span of `kinds` (session_id, pos, kind, and the span's ends) is nothing but old summaries."""
    inside = kinds.where(F.col("pos").between(F.col(first), F.col(last)))
    return inside.groupBy("session_id").agg(F.bool_and(F.col("kind") == "history-summary").alias("isolated"))


def reentry_verdicts(index: DataFrame) -> DataFrame:
    """(session_id, seq, verdict): whether a node that was once replaced may be folded again under pressure.

    `index`: (session_id, seq, kind, turns_after) of the nodes on the surface.
    """
    newest = F.max("seq").over(Window.partitionBy("session_id"))
    verdict = (
        F.when(F.col("kind") == "original", "new-original-content")
        .when(F.col("kind") == "unknown-replacement", "unknown-provenance")
        .when(F.col("turns_after") > 0, "completed-turns-deferred")
        .when(F.col("kind") != "history-summary", "new-original-content")
        .when(newest > F.col("seq"), "new-coverage")
        .otherwise("no-new-coverage")
    )
    return index.select("session_id", "seq", verdict.alias("verdict"))


def tool_debt(nodes: DataFrame, groups: DataFrame, threshold: int = PRUNE_THRESHOLD) -> DataFrame:
    """(session_id, debt, first_pos): tool work that is still owed before history may be folded.

    A result over the threshold is owed first, wherever it is; then a group that may be attempted; groups that may not leave the
    debt inert. `groups`: (session_id, start_pos, may_attempt).
    """
    long = nodes.where((F.col("type") == "tool/result") & (F.col("chars") > threshold)).groupBy("session_id").agg(F.min("pos").alias("long_pos"))
    tried = groups.groupBy("session_id").agg(F.min(F.when(F.col("may_attempt"), F.col("start_pos"))).alias("group_pos"), F.count("*").alias("n"))
    rows = nodes.select("session_id").distinct().join(long, "session_id", "left").join(tried, "session_id", "left")
    first = F.coalesce("long_pos", "group_pos")
    debt = F.when(first.isNotNull(), "actionable").when(F.col("n") > 0, "inert").otherwise("none")
    return rows.select("session_id", debt.alias("debt"), first.alias("first_pos"))


def effective_cursors(records: DataFrame) -> DataFrame:
    """(session_id, cursor) above which events are still to be folded.

    `records`: (session_id, stable_cursor, terminal_cursor, marker, boundary). A fork starts no lower than its boundary; a
    record that was made for another boundary claims nothing.
    """
    floor = F.coalesce(F.col("boundary") - 1, F.lit(-1).cast("long"))
    claimed = F.greatest(F.coalesce("stable_cursor", F.lit(-1)), F.coalesce("terminal_cursor", F.lit(-1)))
    refused = F.col("marker").isNotNull() & ~F.col("marker").eqNullSafe(F.col("boundary"))
    return records.select("session_id", F.when(refused, floor).otherwise(F.greatest(claimed, floor)).alias("cursor"))


def of_lifecycle(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """Rows of exactly one lifecycle of a session: its creation time must be known and equal, its folder equal or absent on both sides."""
    kept = identities.where("created_at is not null").select("session_id", "created_at", F.col("cwd").alias("_cwd"))
    return rows.join(kept, ["session_id", "created_at"]).where(F.col("cwd").eqNullSafe(F.col("_cwd"))).drop("_cwd")
