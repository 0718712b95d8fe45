"""Audit rows: timelines, budgets of attempts, and recovery after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CERTIFYING = ("success", "manual", "repair")
MOST_ATTEMPTS = 2


def classification(outcome: str = "outcome", code: str = "code") -> Column:
    """committed, terminal-infeasible, aborted or transient-failure; an open row counts as aborted."""
    outcome, code = F.col(outcome), F.col(code)
    return (
        F.when(outcome.isNull() | (outcome == "aborted"), "aborted")
        .when(outcome.isin(*CERTIFYING), "committed")
        .when((outcome == "terminal-infeasible") | (code == "BUDGET"), "terminal-infeasible")
        .when(code.isin("ABORTED", "SERVICE_DISPOSED"), "aborted")
        .otherwise("transient-failure")
    )


def timeline(audit: DataFrame) -> DataFrame:
    """The rows in order of time, then request id (by code units), with what they certify."""
    certified = F.coalesce(F.col("outcome").isin(*CERTIFYING), F.lit(False))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("time", "request_id")).cast("long")
    return audit.select(
        "session_id", place.alias("place"), "request_id", "time", classification().alias("classification"), certified.alias("certified"), F.when(certified, F.col("revision")).alias("certified_revision")
    )


def certified_and_repairable(audit: DataFrame) -> DataFrame:
    """(session_id, highest, repair_row): the highest certified revision (0 if none), and the newest open row for the next one."""
    certified = F.coalesce(F.col("outcome").isin(*CERTIFYING), F.lit(False))
    highest = F.coalesce(F.max(F.when(certified, F.col("revision"))).over(Window.partitionBy("session_id")), F.lit(0).cast("long"))
    rows = audit.withColumn("highest", highest)
    open_ = F.col("outcome").isNull() & (F.col("revision") == F.col("highest") + 1)
    return rows.groupBy("session_id").agg(F.max("highest").alias("highest"), F.max(F.when(open_, F.struct("time", "request_id")))["request_id"].alias("repair_row"))


#: Columns of an audit operation, and of the row that operations leave behind.
OPERATION = ["session_id", "request_id", "op_no", "op", "created_at", "cwd", "revision", "outcome", "end_revision", "end_cursor", "stable_revision", "stable_cursor"]
ROW = ["session_id", "request_id", "created_at", "cwd", "revision", "outcome", "end_revision", "end_cursor"]


def operation_verdicts(operations: DataFrame) -> DataFrame:
    """OPERATION rows with `verdict` and `opened`, what each came to.

    `open` starts a row, once for each key. `finish` settles it, and a settled row stays as it is, but that a later success
    replaces a repair. `settle` (a repair from the committed state) takes an open row only, of the same lifecycle and revision, and a
    success or repair among them must name the committed revision and cursor. All of it is order within a key, so no
    row waits for another key's.
    """
    key = Window.partitionBy("session_id", "request_id")
    so_far = key.orderBy("op_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("op") == "open", F.struct("op_no", "created_at", "cwd", "revision"))
    rows = operations.withColumn("opened", F.first(start, ignorenulls=True).over(so_far))
    opened, guarded = F.col("opened"), F.col("op") == "settle"
    certifies = F.coalesce(F.col("outcome").isin("success", "repair"), F.lit(False))
    refused = (
        F.when(opened.isNull(), "missing-key")
        .when(F.col("outcome").isNull(), "no-outcome")
        .when(guarded & ~(F.col("created_at").eqNullSafe(opened["created_at"]) & F.col("cwd").eqNullSafe(opened["cwd"])), "other-lifecycle")
        .when(guarded & ~opened["revision"].eqNullSafe(F.col("stable_revision")), "other-revision")
        .when(guarded & certifies & ~(F.col("end_revision").eqNullSafe(F.col("stable_revision")) & F.col("end_cursor").eqNullSafe(F.col("stable_cursor"))), "uncertified")
    )
    rows = rows.withColumn("refused", F.when(F.col("op") != "open", refused))
    good = (F.col("op") != "open") & F.col("refused").isNull()
    rows = rows.withColumn("first_end", F.min(F.when(good, F.struct("op_no", "outcome"))).over(key))
    late = good & (F.col("op") == "finish") & (F.col("outcome") == "success") & (F.col("first_end.outcome") == "repair") & (F.col("op_no") > F.col("first_end.op_no"))
    rows = rows.withColumn("better", F.min(F.when(late, F.col("op_no"))).over(key))
    verdict = (
        F.when(F.col("op") == "open", F.when(F.col("op_no") == opened["op_no"], "opened").otherwise("already-open"))
        .when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("op_no") == F.col("first_end.op_no"), "settled")
        .when(F.col("op_no") == F.col("better"), "repair-replaced")
        .otherwise("already-settled")
    )
    return rows.withColumn("verdict", verdict).select(*OPERATION, "verdict", "opened")


def merged_audit(rows: DataFrame | None, operations: DataFrame) -> DataFrame:
    """ROW rows after OPERATION rows: those of `rows` (or none) and what the operations make of them, in order of op_no.

    Rows that are there count as operations before all others, so that merging in any split gives the same table.
    """
    before = operations
    if rows is not None:
        null = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
        started = rows.select("session_id", "request_id", F.lit(-2).cast("long").alias("op_no"), F.lit("open").alias("op"), "created_at", "cwd", "revision", F.lit(None).cast("string").alias("outcome"), *null("end_revision", "end_cursor", "stable_revision", "stable_cursor"))
        ended = rows.where("outcome is not null").select("session_id", "request_id", F.lit(-1).cast("long").alias("op_no"), F.lit("finish").alias("op"), "created_at", "cwd", "revision", "outcome", "end_revision", "end_cursor", *null("stable_revision", "stable_cursor"))
        before = operations.select(*OPERATION).unionByName(started).unionByName(ended)
    done = operation_verdicts(before).where(F.col("verdict").isin("opened", "settled", "repair-replaced"))
    last = F.max(F.when(F.col("op") != "open", F.struct("op_no", "outcome", "end_revision", "end_cursor"))).alias("end")
    return done.groupBy("session_id", "request_id").agg(F.first("opened").alias("o"), last).select("session_id", "request_id", "o.created_at", "o.cwd", "o.revision", "end.outcome", "end.end_revision", "end.end_cursor")


def group_store(rows: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Tool-group rows after changes (session_id, request_id, op_no, op, status, diagnostic, ...), newest last: `put` replaces a whole
    row, `update` changes status and diagnostic of a row that is there and is lost where none is."""
    known = changes.where("false").drop("op", "op_no") if rows is None else rows
    at = lambda df, n, op: df.withColumns({"op_no": F.lit(n).cast("long"), "op": F.lit(op)})
    everything = at(known, -1, "put").unionByName(changes)
    fields = [c for c in known.columns if c not in ("session_id", "request_id", "status", "diagnostic")]
    key = ["session_id", "request_id"]
    whole = F.when(F.col("op") == "put", F.struct("op_no", *fields))
    newest = everything.withColumn("_put", F.max(F.when(F.col("op") == "put", F.col("op_no"))).over(Window.partitionBy(*key))).where("op_no >= _put")
    made = newest.groupBy(*key).agg(F.max(whole).alias("w"), F.max(F.struct("op_no", "status", "diagnostic")).alias("s"))
    return made.select(*key, *[f"w.{c}" for c in fields], "s.status", "s.diagnostic").select(*known.columns)


def records_for(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the sessions (session_id, created_at) whose creation time is known and the same; others' lifecycles don't show."""
    return rows.join(sessions.where("created_at is not null").select("session_id", "created_at"), ["session_id", "created_at"], "left_semi")


def recovery(audit: DataFrame, landed: DataFrame, owner: str) -> DataFrame:
    """(session_id, request_id, status, diagnostic): transitions that open and aborted rows owe to what the log proves.

    `landed`: (session_id, fingerprint, landed array). Claims that the log doesn't back abort a row; a landing that it proves
    repairs it; an open row of another owner is aborted; verdicts that a row already has are not written again.
    """
    rows = audit.where(F.col("status").isin("open", "aborted")).join(landed, ["session_id", "fingerprint"], "left")
    proven = F.coalesce("landed", F.array().cast("array<bigint>"))
    status = (
        F.when(F.size(F.array_except("claims", proven)) > 0, F.struct(F.lit("aborted").alias("status"), F.lit("landing-claim-conflict").alias("diagnostic")))
        .when(F.size(proven) > 0, F.struct(F.lit("repaired").alias("status"), F.lit("session-evidence-served").alias("diagnostic")))
        .when((F.col("status") == "open") & ~F.col("owner_id").eqNullSafe(F.lit(owner)), F.struct(F.lit("aborted").alias("status"), F.lit("interrupted-attempt").alias("diagnostic")))
    )
    planned = rows.withColumn("p", status).where(F.col("p").isNotNull())
    same = (F.col("status") == F.col("p.status")) & F.col("diagnostic").eqNullSafe(F.col("p.diagnostic"))
    return planned.where(~same).select("session_id", "request_id", "p.status", "p.diagnostic")


def owed_attempts(audit: DataFrame, landed: DataFrame) -> DataFrame:
    """(session_id, fingerprint, spent, slot, owed): attempts spent, the row to go on with, and whether another is owed.

    A proven landing, a success or a repair ends the work; an open row with claims is served; a fallback refuses unless a row is
    open; else the budget of attempts decides.
    """
    first = lambda status: F.min(F.when(F.col("status") == status, F.col("request_id")))
    has = lambda status: F.coalesce(F.bool_or(F.col("status") == status), F.lit(False))
    groups = audit.groupBy("session_id", "fingerprint").agg(
        F.sum(F.coalesce("attempt", F.lit(1))).alias("spent"),
        first("open").alias("open"),
        first("aborted").alias("aborted"),
        F.min_by(F.size("claims"), F.when(F.col("status") == "open", F.col("request_id"))).alias("open_claims"),
        (has("success") | has("repaired")).alias("served"),
        has("fallback").alias("refused"),
    )
    rows = groups.join(landed, ["session_id", "fingerprint"], "left")
    budget = F.col("spent") < MOST_ATTEMPTS
    owed = (
        F.when(F.size(F.coalesce("landed", F.array().cast("array<bigint>"))) > 0, False)
        .when(F.col("served"), False)
        .when(F.col("open").isNotNull(), (F.col("open_claims") == 0) & budget)
        .when(F.col("refused"), False)
        .otherwise(budget)
    )
    return rows.select("session_id", "fingerprint", F.col("spent").cast("long").alias("spent"), F.coalesce("open", "aborted").alias("slot"), owed.alias("owed"))


def _served() -> Column:
    """Whether a row claims that something of it landed: it succeeded or was repaired, or is open and names replacements."""
    claims = F.coalesce(F.size("claims") > 0, F.lit(False))
    return F.coalesce(F.col("status").isin("success", "repaired") | ((F.col("status") == "open") & claims), F.lit(False))


def served_seqs(audit: DataFrame) -> DataFrame:
    """(session_id, seq): every replacement that an audit row claims to have served, once."""
    return audit.where(_served()).select("session_id", F.explode("claims").alias("seq")).where("seq is not null").distinct()


def first_seen(rows: DataFrame, keys: list[str], order: list[str], values: str, name: str = "merged") -> DataFrame:
    """(keys, `name`): the lists `values` of each key put one after the other by `order`, each value where it first stands.

    Values find their first place before any list is put together, so what a key gathers are its different values only. Nulls and
    empty lists add nothing; a key of nothing else has an empty list.
    """
    placed = rows.select(*keys, F.struct(*order).alias("_order"), F.posexplode_outer(values).alias("_at", "_value"))
    found = placed.groupBy(*keys, "_value").agg(F.min(F.struct("_order", "_at")).alias("_place"))
    listed = F.sort_array(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_place", "_value"))))
    return found.groupBy(*keys).agg(F.transform(listed, lambda x: x["_value"]).alias(name))


def landed_merge(audit: DataFrame) -> DataFrame:
    """(session_id, fingerprint, landed): replacements that the rows of a group claim, oldest row first, each once."""
    return first_seen(audit, ["session_id", "fingerprint"], ["request_id"], "claims", "landed")


def attempt_gates(asks: DataFrame, audit: DataFrame, landings: DataFrame, unwritten: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(session_id, fingerprint, time, gate): whether another attempt was owed when it was asked for, by what was known then.

    `asks`, `landings` (proven by the log) and `unwritten` (attempts that the audit couldn't record): (session_id, fingerprint, time);
    `audit`: (session_id, fingerprint, opened, ended, status, attempt, claims), a row being open until it ended (null: still). Evidence
    comes first, then unwritten attempts, then recorded ones, then what the rows say. All that happened at or before an ask
    counts for it: one pass in order of time, no ask looks anything up.
    """
    zero = {c: F.lit(0).cast("long") for c in ("landed", "lost", "spent", "open_", "claimed", "served", "refused")}
    keys = ["session_id", "fingerprint"]

    def steps(df: DataFrame, time: str, rank: int, **change: Column) -> DataFrame:
        return df.select(*keys, F.col(time).alias("time"), F.lit(rank).alias("rank"), *[change.get(c, z).cast("long").alias(c) for c, z in zero.items()])

    named = (F.coalesce(F.size("claims"), F.lit(0)) > 0).cast("long")
    ended = audit.where("ended is not null")
    everything = [
        steps(asks, "time", 1),
        steps(landings, "time", 0, landed=F.lit(1)),
        steps(unwritten, "time", 0, lost=F.lit(1)),
        steps(audit, "opened", 0, spent=F.coalesce("attempt", F.lit(1)), open_=F.lit(1), claimed=named),
        steps(ended, "ended", 0, open_=F.lit(-1), claimed=-named, served=F.coalesce(F.col("status").isin("success", "repaired"), F.lit(False)).cast("long"), refused=F.coalesce(F.col("status") == "fallback", F.lit(False)).cast("long")),
    ]
    rows = everything[0]
    for more in everything[1:]:
        rows = rows.unionByName(more)
    so_far = Window.partitionBy(*keys).orderBy("time", "rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = rows.withColumns({c: F.sum(c).over(so_far) for c in zero}).where("rank = 1")
    gate = (
        F.when(F.col("landed") > 0, "landed")
        .when(F.col("lost") >= most, "unwritten-exhausted")
        .when(F.col("spent") >= most, "attempts-exhausted")
        .when((F.col("served") > 0) | (F.col("claimed") > 0), "served")
        .when(F.col("open_") > 0, "owed")
        .when(F.col("refused") > 0, "refused")
        .otherwise("owed")
    )
    return known.select(*keys, "time", gate.alias("gate"))
