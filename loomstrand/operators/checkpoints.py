"""Candidates that a model wrote, held against what they were written from, and versions of the state made of them.

Every function takes rows and gives rows with a reason; nothing is raised for a bad candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.functions.text import bounded, is_blank

CLAIM_LISTS = ("facts", "files", "identifiers", "errors")


def summary_violations(items: DataFrame, inputs: DataFrame) -> DataFrame:
    """(group_id, source_seq, reason) of what is wrong with summary items; groups without a row are accepted.

    `items`: (group_id, source_seq, call_id, claims array); `inputs`: (group_id, source_seq, call_id, content). Every input must be
    covered once, nothing else, under its own call id where one is given, and each claim must stand in the input.
    """
    counted = items.withColumn("_times", F.count("*").over(Window.partitionBy("group_id", "source_seq")))
    known = inputs.select("group_id", "source_seq", F.col("call_id").alias("_call"), "content", F.lit(True).alias("_known"))
    groups = items.select("group_id").distinct()
    both = counted.withColumn("_given", F.lit(True)).join(known.join(groups, "group_id", "left_semi"), ["group_id", "source_seq"], "full")
    loose = F.exists(F.coalesce("claims", F.array().cast("array<string>")), lambda c: is_blank(c) | ~F.contains(F.coalesce("content", F.lit("")), c))
    reason = (
        F.when(F.col("_known").isNull(), "unknown-source")
        .when(F.col("_given").isNull(), "missing-source")
        .when(F.col("_times") > 1, "duplicate-source")
        .when(F.col("call_id").isNotNull() & ~F.col("call_id").eqNullSafe(F.col("_call")), "call-mismatch")
        .when(loose, "claim-not-in-source")
    )
    return both.select("group_id", "source_seq", reason.alias("reason")).where("reason is not null").distinct()


def entry_verdicts(candidates: DataFrame, base: DataFrame, max_bytes: int = 200, max_entries: int = 50) -> DataFrame:
    """(session_id, kind, ordinal, content, id, reason): entries with the id that they keep or get, or why they can't stay.

    `candidates`: (session_id, kind, ordinal, id, content) with a null id for new entries; `base`: (session_id, id, kind, content). An
    echoed id must be in the base, once, in the same list, with the same words. New ids come from session, kind, place and words, so
    that a run again gives the same.
    """
    rows = candidates.withColumn("content", bounded("content", max_bytes))
    rows = rows.withColumns(
        {
            "_times": F.count("id").over(Window.partitionBy("session_id", "id")),
            "_size": F.count("*").over(Window.partitionBy("session_id", "kind")),
        }
    )
    known = base.select("session_id", "id", F.col("kind").alias("_kind"), F.col("content").alias("_content"))
    rows = rows.join(known, ["session_id", "id"], "left")
    echoed = F.col("id").isNotNull()
    reason = (
        F.when(F.col("_size") > max_entries, "too-many-entries")
        .when(echoed & F.col("_kind").isNull(), "unknown-id")
        .when(echoed & (F.col("_times") > 1), "repeated-id")
        .when(echoed & (F.col("_kind") != F.col("kind")), "moved-id")
        .when(echoed & (F.col("_content") != F.col("content")), "changed-content")
    )
    minted = F.concat("kind", F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "session_id", "kind", "ordinal", "content"), 256), 1, 16))
    return rows.select("session_id", "kind", "ordinal", "content", F.coalesce("id", minted).alias("id"), reason.alias("reason"))


def evidence_split(references: DataFrame, included: DataFrame) -> DataFrame:
    """`references` (session_id, seq, ...) with kept: whether the fold really held that event; the others are quarantined."""
    held = included.select("session_id", "seq").distinct().withColumn("_held", F.lit(True))
    return references.join(held, ["session_id", "seq"], "left").withColumn("kept", F.coalesce("_held", F.lit(False))).drop("_held")


def merged_edit(edited: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, kind, ordinal, content, id, kept): edited texts take the ids of entries with the same words, each used once."""
    place = lambda order: F.row_number().over(Window.partitionBy("session_id", "kind", "content").orderBy(order))
    texts = edited.withColumn("_n", place("ordinal"))
    entries = current.withColumn("_n", place("id")).select("session_id", "kind", "content", "_n", "id")
    rows = texts.join(entries, ["session_id", "kind", "content", "_n"], "left")
    minted = F.concat("kind", F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "session_id", "kind", "ordinal", "content"), 256), 1, 16))
    return rows.select("session_id", "kind", "ordinal", "content", F.coalesce("id", minted).alias("id"), F.col("id").isNotNull().alias("kept"))


def edit_outcomes(edits: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, outcome, revision): not-found, conflict (another revision was edited), invalid, or ok with the next revision."""
    rows = edits.join(current.select("session_id", F.col("revision").alias("_now")), "session_id", "left")
    outcome = F.when(F.col("_now").isNull(), "not-found").when(F.col("revision") != F.col("_now"), "conflict").when(~F.col("valid"), "invalid").otherwise("ok")
    return rows.select("session_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("_now") + 1).alias("revision"))


def content_digest(entries: DataFrame) -> DataFrame:
    """(session_id, digest): SHA-256 over kinds, ids and words in order; nothing else about a state enters."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("kind", "ordinal", "id", "content"))), lambda e: F.concat_ws("|", e["kind"], e["id"], e["content"]))
    return entries.groupBy("session_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest"))


def entry_violations(entries: DataFrame) -> DataFrame:
    """(session_id, id, reason): blank or untrimmed words, and ids that stand in more than one place."""
    times = F.count("*").over(Window.partitionBy("session_id", "id"))
    reason = F.when(is_blank("content"), "blank").when(F.regexp_like("content", F.lit(r"(?U)^\s|\s$")), "untrimmed").when(F.col("_times") > 1, "duplicate-id")
    return entries.withColumn("_times", times).select("session_id", "id", reason.alias("reason")).where("reason is not null").distinct()
