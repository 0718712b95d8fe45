"""The one slot of a session that shows its durable state: its text under two budgets, and what to do with slots that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstrand.functions.text import token_estimate

# Lines of the rendered state.
STALE = "[Task-state snapshot is stale; durable cursor lags eligible session events.]"
TRUNCATED = "[Task-state snapshot truncated; the committed durable state remains authoritative.]"
GOAL_CLEARED = "Current goal: cleared (no authoritative goal is set)."
TODO_CLEARED = "TODO list: cleared (the authoritative list is empty)."
SECTIONS = (("facts", "Facts:"), ("decisions", "Decisions:"), ("constraints", "Constraints:"), ("risks", "Risks:"))


def _only_if(condition: Column, *lines: Column | str) -> Column:
    made = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return F.when(F.coalesce(condition, F.lit(False)), made).otherwise(F.array().cast("array<string>"))


def authoritative_lines() -> Column:
    """Header, staleness, goal and TODO lines of a row with revision, source_cursor, digest, high_water, goal and todo."""
    goal, todo = F.col("goal"), F.col("todo")
    header = F.concat(F.lit("Durable task state (revision "), "revision", F.lit(", source event "), "source_cursor", F.lit(", digest "), "digest", F.lit(")."))
    identity = F.concat_ws(", ", F.concat(F.lit("goal "), goal["goal_id"]), F.concat(F.lit("revision "), goal["revision"]), F.concat(F.lit("phase "), goal["phase"]))
    items = F.transform(todo["items"], lambda i: F.concat(F.lit("- ["), i["status"], F.lit("] "), i["content"]))
    return F.concat(
        F.array(header),
        _only_if(F.col("high_water") > F.col("source_cursor"), STALE),
        _only_if(goal["status"] == "cleared", GOAL_CLEARED),
        _only_if(goal["status"] == "current", F.concat(F.lit("Current goal: "), F.coalesce(goal["objective"], F.lit("(no objective recorded)")))),
        _only_if((goal["status"] == "current") & (identity != ""), F.concat(F.lit("Goal identity: "), identity)),
        _only_if(todo["status"] == "cleared", TODO_CLEARED),
        _only_if(todo["status"] == "current", F.coalesce(F.concat(F.lit("TODO list (session event "), todo["source_seq"], F.lit("):")), F.lit("TODO list:"))),
        F.when(todo["status"] == "current", items).otherwise(F.array().cast("array<string>")),
    )


def further_lines(sections: tuple[tuple[str, str], ...] = SECTIONS) -> Column:
    """A blank line and the entry lists of a row, in their fixed order; nothing if all are empty."""
    parts = [F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), F.transform(c, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>")) for c, title in sections]
    lists = F.concat(*parts)
    return F.when(F.size(lists) > 0, F.concat(F.array(F.lit("")), lists)).otherwise(F.array().cast("array<string>"))


def rendered(states: DataFrame, max_bytes: int, max_tokens: int) -> DataFrame:
    """`states` with text, truncated, blocked and tokens.

    The whole text if it fits; else as many lines from the first on as fit with the mark of truncation, of which the
    authoritative lines must all be; else nothing, and the slot is blocked.
    """
    fits = lambda t: (F.octet_length(t) <= max_bytes) & (token_estimate(t) <= max_tokens)
    joined = lambda n: F.array_join(F.slice("lines", F.lit(1), n), "\n")
    marked = lambda n: F.concat(joined(n), F.lit("\n" + TRUNCATED))
    rows = states.withColumn("authority", authoritative_lines()).withColumn("lines", F.concat("authority", further_lines()))
    least, most = F.size("authority"), F.size("lines")
    rows = rows.withColumn("full", F.array_join("lines", "\n"))
    kept = F.array_max(F.filter(F.sequence(least, most), lambda n: fits(marked(n))))
    rows = rows.withColumn("kept", F.when(fits(F.col("full")), most).when(least < most, kept))
    text = F.when(fits(F.col("full")), F.col("full")).when(F.col("kept").isNotNull(), marked(F.col("kept"))).otherwise("")
    rows = rows.withColumn("text", text)
    return rows.withColumns(
        {
            "truncated": (F.col("text") != "") & (F.col("text") != F.col("full")),
            "blocked": F.col("text") == "",
            "tokens": F.when(F.col("text") == "", 0).otherwise(token_estimate("text")).cast("long"),
        }
    ).drop("authority", "lines", "full", "kept")


def slot_decisions(visible: DataFrame, wanted: DataFrame, generations: DataFrame) -> DataFrame:
    """(session_id, decision, generation, covered): what maintenance does with the visible slots of each session.

    `visible`: (session_id, pos, seq, own, text); `wanted`: (session_id, text), an empty text being blocked; `generations`: the
    highest generation of the whole log. Several slots collapse into one only where they are neighbours.
    """
    have = visible.groupBy("session_id").agg(
        F.count("*").alias("n"),
        (F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("contiguous"),
        F.sort_array(F.collect_list(F.struct("pos", "seq"))).alias("nodes"),
        F.bool_and("own").alias("own"),
        F.max("text").alias("shown"),
    )
    rows = wanted.join(have, "session_id", "left").join(generations, "session_id", "left")
    n = F.coalesce("n", F.lit(0))
    decision = (
        F.when(F.col("text") == "", "blocked")
        .when((n > 1) & ~F.col("contiguous"), "refuse")
        .when(n > 1, "collapse")
        .when(n == 0, "create")
        .when(F.col("own") & (F.col("shown") == F.col("text")), "keep")
        .otherwise("replace")
    )
    rows = rows.withColumn("decision", decision)
    writes = F.col("decision").isin("collapse", "create", "replace")
    covered = F.when(F.col("decision").isin("collapse", "replace"), F.array_join(F.transform("nodes", lambda x: x["seq"].cast("string")), ","))
    return rows.select("session_id", "decision", F.when(writes, F.coalesce("generation", F.lit(0)) + 1).cast("long").alias("generation"), covered.alias("covered"))


def visible_slot_tokens(visible: DataFrame, prices: DataFrame) -> DataFrame:
    """(session_id, injection_tokens): what each session's first visible slot costs: its measured price, else what was recorded for it, else 0.

    `visible`: (session_id, pos, seq, recorded); `prices`: (session_id, seq, tokens).
    """
    first = visible.groupBy("session_id").agg(F.min(F.struct("pos", "seq", "recorded")).alias("slot")).select("session_id", "slot.seq", "slot.recorded")
    rows = first.join(prices.select("session_id", "seq", "tokens"), ["session_id", "seq"], "left")
    return rows.select("session_id", F.coalesce("tokens", "recorded", F.lit(0)).cast("long").alias("injection_tokens"))


def slot_diagnostics(visible: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, slot_seq, generation, revision, digest, text_bytes, stale, tokens, truncated) of every session with a state.

    `visible`: (session_id, seq, generation) of slots that are shown, of which the newest counts; `states`: what `rendered` gives.
    """
    newest = visible.groupBy("session_id").agg(F.max(F.struct("generation", "seq")).alias("slot"))
    rows = states.join(newest, "session_id", "left")
    return rows.select("session_id", F.col("slot.seq").alias("slot_seq"), "slot.generation", "revision", "digest", F.octet_length("text").cast("long").alias("text_bytes"), (F.col("high_water") > F.col("source_cursor")).alias("stale"), "tokens", "truncated")
