"""From a log with positional replacements to the current surface, and what its nodes are.

A replacement takes the place of the nodes that it covers; they stay in the log but leave the surface. Order on the surface goes
by place, never by seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.files import settled

SEEN = ("user/message", "assistant/message", "tool/result")


def with_roots(log: DataFrame) -> DataFrame:
    """Adds the place of each node: its own seq, or the place of the first node that it covers, however deep.

    Only replacements have anything to follow, so only (session, seq, root) of those go round: pointers are doubled in every round, and
    the rounds grow with the logarithm of the depth.
    """
    covers = F.size(F.coalesce("covers", F.array().cast("array<bigint>"))) > 0
    places = settled(log.where(covers).select("session_id", "seq", F.get("covers", F.lit(0)).alias("root")))
    while True:
        above = places.select("session_id", F.col("seq").alias("root"), F.col("root").alias("_next"))
        moved = settled(places.join(above, ["session_id", "root"], "left").select("session_id", "seq", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        places = moved.drop("_moved")
        if not moved.where("_moved").head(1):
            break
    found = log.join(places.select("session_id", "seq", F.col("root").alias("_root")), ["session_id", "seq"], "left")
    return found.select(*[log[c] for c in log.columns if c not in ("session_id", "seq", "root")], "session_id", "seq", F.coalesce("_root", "seq").alias("root"))


def replay(log: DataFrame) -> DataFrame:
    """The surface of a log of (session_id, seq, type, covers, ...), with positions."""
    gone = log.where(F.size("covers") > 0).select("session_id", F.explode("covers").alias("seq")).distinct()
    seen = with_roots(log).where(F.col("type").isin(*SEEN)).join(gone, ["session_id", "seq"], "left_anti")
    return seen.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("root", F.desc("seq"))).cast("long") - 1)


def generations(log: DataFrame) -> DataFrame:
    """(session_id, generation): how many replacements a session has seen."""
    return log.groupBy("session_id").agg(F.count_if(F.size("covers") > 0).alias("generation"))


def turns_after(log: DataFrame) -> DataFrame:
    """Adds to each row the number of turns that were completed after it: a running count from the newest row on."""
    later = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    done = (F.col("type") == "turn/end") & F.coalesce(F.col("reason") == "completed", F.lit(False))
    return log.withColumn("turns_after", F.coalesce(F.count_if(done).over(later), F.lit(0)))


def source_index(log: DataFrame, reentry_turns: int = 1) -> DataFrame:
    """(session_id, seq, kind, turns_after, foldable) of every log row that is or was a node.

    A replaced tool result counts as pruned only if the row just before it in the log is its prune event and names what it covers;
    otherwise nothing proves what it holds.
    """
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    covers = F.size("covers") > 0
    proven = (F.lag("type").over(by_seq) == "compaction/prune") & (F.lag("seq").over(by_seq) == F.col("seq") - 1) & (F.lag("shadow").over(by_seq) == F.element_at("covers", 1)) & (F.size("covers") == 1)
    rows = turns_after(log).withColumn("_proven", F.coalesce(covers & proven, F.lit(False)))
    kind = (
        F.when((F.col("type") == "user/message") & (F.col("source_kind") == "slot"), "task-state-slot")
        .when((F.col("type") == "user/message") & covers & (F.col("source_kind") == "checkpoint"), "history-summary")
        .when((F.col("type") != "tool/result") | ~covers, "original")
        .when(F.col("_proven"), "tool-pruned")
        .otherwise("unknown-replacement")
    )
    rows = rows.where(F.col("type").isin(*SEEN)).withColumn("kind", kind)
    aged = F.when(F.col("kind") == "original", 0).otherwise(F.col("turns_after"))
    foldable = (F.col("kind") == "original") | ((F.col("kind") != "unknown-replacement") & (aged >= reentry_turns))
    return rows.select("session_id", "seq", "kind", aged.cast("long").alias("turns_after"), foldable.alias("foldable"))


def evidence_counters(log: DataFrame) -> DataFrame:
    """(session_id, requests, pruner, compaction): what the log proves was done; works on a batch and on a stream."""
    count = lambda kind: F.count_if(F.col("type") == kind)
    return log.groupBy("session_id").agg(count("request/header").alias("requests"), count("compaction/prune").alias("pruner"), count("compaction/end").alias("compaction"))


def newest_lock(log: DataFrame) -> DataFrame:
    """(session_id, seq, lock_id) of the newest compaction start that no later end of the same id and no later seed released."""
    starts = log.where("type = 'compaction/start'").select("session_id", "seq", "lock_id")
    ends = log.where("type = 'compaction/end'").groupBy("session_id", "lock_id").agg(F.max("seq").alias("ended"))
    seeds = log.where("type = 'session/end-seed'").groupBy("session_id").agg(F.max("seq").alias("seeded"))
    held = starts.join(ends, ["session_id", "lock_id"], "left").join(seeds, "session_id", "left")
    held = held.where((F.coalesce("ended", F.lit(-1)) < F.col("seq")) & (F.coalesce("seeded", F.lit(-1)) < F.col("seq")))
    return held.groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("lock_id", "seq").alias("lock_id"))


def digests(log: DataFrame) -> DataFrame:
    """(session_id, seq, digest) of every replacement: SHA-256 over kind, place and what it covers."""
    parts = F.concat_ws("|", F.lit("v1"), "session_id", "seq", "type", F.array_join(F.transform("covers", lambda c: c.cast("string")), ","))
    return log.where(F.size("covers") > 0).select("session_id", "seq", F.sha2(parts, 256).alias("digest"))
