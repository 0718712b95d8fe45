"""Control stream: a baseline and updates of each session's newest state, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstrand.sources.keyed import KeyedTable
from loomstrand.streaming.tables import merge_stream

FRAME = "struct<session_id: bigint, arrival: bigint, kind: string, revision: bigint, stable: string>"


def decoded(raw: DataFrame, column: str = "value") -> DataFrame:
    """Frames from JSON text; what doesn't parse, or lacks session, kind or revision, goes to null and is left out."""
    frame = F.from_json(column, FRAME)
    good = F.col("f.session_id").isNotNull() & F.col("f.kind").isin("baseline", "update") & F.col("f.revision").isNotNull()
    return raw.select(frame.alias("f")).where(good).select("f.*")


def latest(frames: DataFrame) -> DataFrame:
    """(session_id, revision, stable): the newest revision wins, then the latest arrival; frames that come late change nothing.

    A frame without a state clears its session, which stays with a null state.
    """
    newest = F.max(F.struct("revision", "arrival", "stable")).alias("n")
    return frames.groupBy("session_id").agg(newest).select("session_id", "n.revision", "n.stable")


def _last_run(rows: DataFrame, generation: str) -> DataFrame:
    """Frames of each session's last unbroken stay, with `last`, the generation that it reaches.

    A stay goes on into the next generation if its baseline lists the session; a session that comes back later, or by an
    update behind a baseline without it, starts anew.
    """
    own = Window.partitionBy("host", "session_id")
    before = F.lag(generation).over(own.orderBy(generation, "arrival"))
    goes_on = (F.col(generation) == before) | ((F.col(generation) == before + 1) & (F.col("kind") == "baseline"))
    rows = rows.withColumn("_starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_starts").over(own.orderBy(generation, "arrival").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_newest", F.max("_run").over(own)).where("_run = _newest")
    return rows.withColumn("last", F.max(generation).over(own)).drop("_starts", "_run", "_newest")


def mirror(frames: DataFrame) -> DataFrame:
    """(host, session_id, generation, revision, stable): what each host shows at the end of its frames.

    `frames`: (host, generation, arrival, kind, session_id, revision, stable). A host's stream is opened again and again, each time with a
    baseline, which replaces the whole set of sessions: one that it doesn't list is gone, and what it says is only held against
    what was there just before. Updates change a session or add one. A frame without a state clears it, whatever its revision;
    else only a higher revision counts. A baseline row without a session opens a generation that lists none. Updates of a
    generation that was never opened say nothing.

    What a session shows is decided behind the last clearing in its last unbroken stay: no fold over frames is needed, and no
    window is wider than a session.
    """
    opened = frames.where("kind = 'baseline'").select("host", "generation").distinct()
    ranks = opened.select("host", "generation", F.row_number().over(Window.partitionBy("host").orderBy("generation")).alias("rank"))
    newest = ranks.groupBy("host").agg(F.max(F.struct("rank", "generation")).alias("now"))
    rows = frames.where("session_id is not null").join(ranks, ["host", "generation"]).join(newest, "host")
    own = Window.partitionBy("host", "session_id")
    rows = _last_run(rows, "rank").where(F.col("last") == F.col("now.rank"))
    order = F.struct("rank", "arrival")
    rows = rows.withColumn("cleared", F.max(F.when(F.col("revision").isNull(), order)).over(own))
    rows = rows.withColumn("counts", F.col("revision").isNotNull() & (F.col("cleared").isNull() | (order > F.col("cleared"))))
    best = F.max(F.when(F.col("counts"), F.struct("revision", (-F.col("rank")).alias("r"), (-F.col("arrival")).alias("a"), "stable"))).alias("best")
    return rows.groupBy("host", "session_id").agg(F.first("now.generation").alias("generation"), best).select("host", "session_id", "generation", "best.revision", "best.stable")


#: What is kept of a session between batches: its newest generation, the last arrival that counted there, and what it shows.
MIRRORED = ["host", "session_id", "generation", "seen", "revision", "stable"]


def mirror_rows(before: DataFrame | None, frames: DataFrame) -> DataFrame:
    """MIRRORED rows after more frames, for a `KeyedTable` with keys host and session_id.

    Generations of a host are numbered without gaps, as it opens them; rows without a session say which it has opened. A frame at or
    below what its session has seen is a replay.
    """
    known = frames.select("host", "session_id", "generation", "arrival", "kind", "revision", "stable", F.lit(True).alias("fresh"))
    if before is not None:
        known = known.unionByName(before.select("host", "session_id", "generation", F.col("seen").alias("arrival"), F.lit("update").alias("kind"), "revision", "stable", F.lit(False).alias("fresh")))
    own = Window.partitionBy("host", "session_id")
    order = F.struct("generation", "arrival")
    rows = known.withColumn("held", F.max(F.when(~F.col("fresh"), order)).over(own))
    rows = rows.where(~F.col("fresh") | F.col("held").isNull() | (order > F.col("held")))
    rows = _last_run(rows, "generation")
    rows = rows.withColumn("cleared", F.max(F.when(F.col("revision").isNull(), order)).over(own))
    counts = F.col("revision").isNotNull() & (F.col("cleared").isNull() | (order > F.col("cleared")))
    best = F.max(F.when(counts, F.struct("revision", (-F.col("generation")).alias("g"), (-F.col("arrival")).alias("a"), "stable"))).alias("best")
    made = rows.groupBy("host", "session_id").agg(F.max(order).alias("last"), best)
    return made.select("host", "session_id", "last.generation", F.col("last.arrival").alias("seen"), "best.revision", "best.stable")


def shown(rows: DataFrame) -> DataFrame:
    """What MIRRORED rows show: sessions that a host's newest generation has."""
    newest = rows.groupBy("host").agg(F.max("generation").alias("now"))
    return rows.where("session_id is not null").join(newest, "host").where("generation = now").select("host", "session_id", "generation", "revision", "stable")


def mirror_stream(frames: DataFrame, store: KeyedTable, checkpoint: str, epoch: int = 0) -> StreamingQuery:
    """Keep a `KeyedTable` of MIRRORED rows up to date; run on what is there, then stop."""
    return merge_stream(frames, store, mirror_rows, checkpoint, epoch)


def upsert_rows(before: DataFrame | None, frames: DataFrame) -> DataFrame:
    """(session_id, revision, arrival, kind, stable) after more frames: the newest revision, then the latest arrival."""
    known = frames.select("session_id", "arrival", "kind", "revision", "stable")
    if before is not None:
        known = known.unionByName(before)
    newest = known.groupBy("session_id").agg(F.max(F.struct("revision", "arrival", "kind", "stable")).alias("n"))
    return newest.select("session_id", "n.*")


def upsert_stream(frames: DataFrame, store: KeyedTable, checkpoint: str, epoch: int = 0) -> StreamingQuery:
    """Keep the newest state of every session in a `KeyedTable`; run on what is there, then stop."""
    return merge_stream(frames, store, upsert_rows, checkpoint, epoch)
