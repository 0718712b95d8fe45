"""Names of the session-log queries, with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstrand.functions import blocks, budgets, text
from loomstrand.functions.rows import once
from loomstrand.operators import audits, checkpoints, events, fitting, lineage, reductions, replay, segments, slots, surfaces, zones
from loomstrand.oracles import ORACLE_SQL as SURFACE_SQL
from loomstrand.oracles_folds import ORACLE_SQL as FOLD_SQL
from loomstrand.plans import config, pressure
from loomstrand.sources import logs
from loomstrand.streaming import control

ORACLE_SQL = SURFACE_SQL | FOLD_SQL
WINDOW = 60_000
RECENT, FORGET = WINDOW // 5, WINDOW // 2


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.with_zones(zones.with_cuts(logs.surface_of(logs.tool_log(spark, sf_dir))), RECENT, FORGET)


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every message."""
    return logs.conv_log(spark, sf_dir).select("session_id", "seq", "tokens")


def zone_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone totals of every conversation."""
    surface = logs.surface_of(logs.conv_log(spark, sf_dir))
    return zones.zone_totals(zones.with_zones(zones.with_cuts(surface), 200, 500))


def zone_partition_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone totals where calls, results and steps must not be parted."""
    return zones.zone_totals(_zoned(spark, sf_dir))


def pairing_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open calls before and after every node."""
    return zones.pairing_balance(logs.surface_of(logs.tool_log(spark, sf_dir)))


def forget_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest batch of every session's forget zone."""
    return zones.forget_batch(_zoned(spark, sf_dir), 4_000, 6_000)


def pressure_span_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span that would end pressure in every session."""
    return zones.pressure_span(_zoned(spark, sf_dir), reclaim=8_000, cap=20_000, least=1_000)


def legacy_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every session's tail starts if only pairs, not steps, must stay whole."""
    rows = zones.tail_start(zones.with_cuts(logs.surface_of(logs.tool_log(spark, sf_dir))), RECENT, "tail_start", step_checked=False)
    return rows.groupBy("session_id").agg(F.max("tail_start").alias("tail_start"))


def retained_tail_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the turns that every session must keep."""
    log = logs.tool_log(spark, sf_dir)
    return zones.retained_tail_floor(logs.surface_of(log), log)


def envelope_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of a call in every session, with an envelope that grows with the session's number."""
    sums = logs.surface_of(logs.tool_log(spark, sf_dir)).groupBy("session_id").agg(F.sum("tokens").alias("s"))
    total = F.col("s") + F.col("session_id") % 5 * 3000
    call = budgets.call_budget(total, F.col("s"), window=WINDOW, reserve=8192, margin=2048, instruction=500, checkpoint=1000, tail=RECENT, tail_min=2000)
    zone = budgets.zone_budget(total, F.col("s"), waterline=42_000, pressure=48_000, forget=FORGET, tail=RECENT, tail_min=2000)
    out = sums.select("session_id", call.alias("c"), zone.alias("z"))
    return out.select("session_id", "c.*", F.col("z.forget").alias("zone_forget"), "z.deficit", F.col("z.dominated").alias("zone_dominated"))


def prune_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, marker and tail of every overlong document taken as a tool result."""
    docs = logs.table(spark, sf_dir, "documents").where(F.length("text") > text.PRUNE_THRESHOLD)
    cut = text.pruned("text")
    return docs.select(
        (F.col("doc_id") % 50).alias("session_id"), F.col("doc_id").alias("seq"), F.length("text").cast("long").alias("chars_before"), F.length(cut).cast("long").alias("chars_after"), F.md5(cut.cast("binary")).alias("digest")
    )


def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document within 100 bytes."""
    docs = logs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.bounded("text", 100).alias("bounded"), (F.octet_length("text") > 100).alias("truncated"))


def tool_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool segments of every session."""
    nodes = segments.with_segments(zones.with_cuts(logs.surface_of(logs.tool_log(spark, sf_dir))))
    return segments.totals(nodes, "segment").drop("segment")


def segment_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that owns every row of every log, if one does."""
    log = logs.tool_log(spark, sf_dir)
    surface = logs.surface_of(log)
    return segments.segment_owners(segments.with_segments(zones.with_cuts(surface)), surface, log)


def tool_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two groups of every session that pass the thresholds, oversized segments cut into chunks."""
    return segments.tool_groups(_zoned(spark, sf_dir)).drop("segment", "chunk")


def group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment cut into chunks of at most 3,000 tokens."""
    nodes = segments.with_segments(zones.with_cuts(logs.surface_of(logs.tool_log(spark, sf_dir))))
    return segments.totals(segments.with_chunks(nodes, 3_000), "segment", "chunk").drop("segment", "chunk")


def eligible_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of segments without a long result, as if long ones had been replaced."""
    nodes = segments.with_segments(zones.with_cuts(logs.surface_of(logs.tool_log(spark, sf_dir))))
    return segments.eligible_spans(nodes.withColumn("eligible", F.col("chars") <= 6000)).drop("segment")


def surface_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface of every session after prunes and summaries."""
    return replay.replay(logs.replaced_log(spark, sf_dir)).select("session_id", "pos", "seq", "root", "type")


def surface_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many replacements every session has seen."""
    return replay.generations(logs.replaced_log(spark, sf_dir))


def turns_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns completed after every log row."""
    return replay.turns_after(logs.tool_log(spark, sf_dir)).select("session_id", "seq", "turns_after")


def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every node is, by what the log proves."""
    return replay.source_index(logs.replaced_log(spark, sf_dir))


def provenance_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every replacement."""
    return replay.digests(logs.replaced_log(spark, sf_dir))


def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every replaced result's record says, or why it proves nothing."""
    return lineage.read_back(logs.provenance_log(spark, sf_dir)).select("session_id", "seq", F.col("record.kind").alias("kind"), F.col("record.group_id").alias("group_id"), F.col("record.digest").alias("digest"), "fault")


def replacement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every replacement covers, and how many events are behind it in the end."""
    log = logs.provenance_log(spark, sf_dir)
    claims = log.where("type = 'tool/result' and size(covers) > 0 and (session_id + seq) % 3 = 0").select("session_id", "seq")
    return lineage.replacement_coverage(log, claims)


def reentry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes may be folded again, after two turns or at once."""
    log = logs.provenance_log(spark, sf_dir)
    later = lineage.source_kinds(log, reentry_turns=2)
    now = lineage.source_kinds(log, reentry_turns=2, immediate=True, inherited_before=60)
    return later.select("session_id", "seq", "kind", "turns_after", "foldable").join(now.select("session_id", "seq", F.col("foldable").alias("at_once")), ["session_id", "seq"])


def unrecorded_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose summaries the log proves and the audit doesn't know."""
    return lineage.unrecorded_landings(logs.provenance_log(spark, sf_dir), logs.group_audit(spark, sf_dir).where("status = 'success' and size(claims) > 0"))


def evidence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every session's log proves was done."""
    return replay.evidence_counters(logs.replaced_log(spark, sf_dir))


def compaction_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest compaction start that nothing released."""
    return replay.newest_lock(logs.lock_log(spark, sf_dir))


def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of every conversation and authority event."""
    log = logs.json_log(spark, sf_dir).unionByName(logs.authority_log(spark, sf_dir)).unionByName(logs.marker_log(spark, sf_dir))
    cuts = F.transform("truncation", lambda c: F.concat_ws(":", c["path"], c["limit_bytes"], c["kept_bytes"]))
    return events.projected(log).select("session_id", "seq", "type", "kind", "fields", F.array_join(cuts, ",").alias("truncation"))


def authority_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest goal and TODO list of every session."""
    views = events.authority_views(logs.authority_log(spark, sf_dir))
    items = F.array_join(F.transform("todo.items", lambda i: F.concat(i["content"], F.lit(" ["), i["status"], F.lit("]"))), "; ")
    return views.select(
        "session_id", F.col("goal.status").alias("goal_status"), "goal.goal_id", F.col("goal.revision").alias("goal_revision"), "goal.objective", F.col("todo.status").alias("todo_status"), "todo.source_seq", items.alias("items")
    )


def view_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of every session's first 15 events carried on by the rest, and what that changed."""
    log = logs.authority_log(spark, sf_dir)
    nothing = events.authority_views(log.limit(0)).withColumn("through", F.lit(-1).cast("long"))
    base = events.carried_views(nothing, log.where("seq < 15"))
    now = events.carried_views(base, log.where("seq >= 10"))
    said = lambda c: F.array_join(c, ",")
    changes = events.view_changes(base, now).select("session_id", said(F.col("changed")).alias("changed"), said(F.col("cleared")).alias("cleared"))
    return now.select("session_id", F.col("goal.status").alias("goal_status"), "goal.objective", F.col("todo.status").alias("todo_status"), "todo.source_seq", "through").join(changes, "session_id")


def urgent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority events that can't wait for a full window."""
    return events.urgent_events(logs.authority_log(spark, sf_dir))


def batch_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 12 TODO writes above every session's cursor."""
    log = logs.authority_log(spark, sf_dir).where("type = 'todo/write'")
    cursors = log.select("session_id").distinct().withColumn("cursor", F.col("session_id") % 20 - 1)
    return events.counted_windows(log, cursors, 12)


def batch_window_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fold of every session within 20 events and 2,000 bytes."""
    return events.byte_windows(events.projected(logs.json_log(spark, sf_dir), events.Limits(user_message=200, assistant_message=200)), 20, 2_000)


def fold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fold of every conversation within 20 events and 3,000 bytes, from bases of different sizes."""
    log = logs.json_log(spark, sf_dir)
    state = F.when(F.col("session_id") % 3 > 0, F.concat(F.lit('{"facts":"'), F.repeat(F.lit("é"), (F.col("session_id") % 29 * 60).cast("int")), F.lit('"}')))
    return fitting.event_windows(events.projected(log), log.select("session_id").distinct().select("session_id", state.alias("base")), 20, 3_000)


def group_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every eight nodes of tool work one request of 3,000 tokens can hold."""
    nodes = logs.surface_of(logs.tool_log(spark, sf_dir)).where("type <> 'user/message'").withColumn("group_id", F.floor(F.col("pos") / 8))
    call = F.array(F.struct(F.concat(F.lit("tool_"), F.col("k") % 5).alias("name"), F.concat(F.lit('{"k": '), "k", F.lit("}")).alias("arguments")))
    calls = F.when(F.col("tool_calls") > 0, F.array_repeat(call[0], F.col("tool_calls").cast("int"))).otherwise(F.slice(call, 1, 0))
    item = fitting.input_item(F.col("type"), F.col("seq"), F.concat(F.lit("c"), "seq"), F.repeat(F.lit('x"é\n👍'), F.floor(F.col("chars") / 10).cast("int")), calls)
    return fitting.group_inputs(nodes.select("session_id", "group_id", "pos", item.alias("item")), cap=3_000, reserve=400, instruction="Sum up.")


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of every authority payload."""
    rows = events.json_leaves(logs.authority_log(spark, sf_dir).where("data is not null"), "data")
    return rows.select("session_id", "seq", F.explode("leaves").alias("path", "leaf"))


def audit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's audit rows in order."""
    return audits.timeline(logs.audit_log(spark, sf_dir))


def audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest certified revision of every session, and the row that a repair would certify."""
    return audits.certified_and_repairable(logs.audit_log(spark, sf_dir))


def audit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart writes to open and aborted rows."""
    return audits.recovery(logs.group_audit(spark, sf_dir), logs.group_landings(spark, sf_dir), "me")


def audit_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts spent on every group, and whether another is owed."""
    return audits.owed_attempts(logs.group_audit(spark, sf_dir), logs.group_landings(spark, sf_dir))


def served_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements that audit rows claim to have served."""
    return audits.served_seqs(logs.group_audit(spark, sf_dir))


def landed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of every group claim, in order of first claim."""
    return audits.landed_merge(logs.group_audit(spark, sf_dir)).select("session_id", "fingerprint", F.array_join(F.col("landed").cast("array<string>"), ",").alias("landed"))


def attempt_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an attempt was owed at every ask, by what was known then."""
    return audits.attempt_gates(*logs.attempt_events(spark, sf_dir))


def group_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every session's tool work in runs of eight nodes, with its call ids in order of first sight."""
    nodes = logs.surface_of(logs.tool_log(spark, sf_dir)).where("type <> 'user/message'").withColumn("group_id", F.floor(F.col("pos") / 8))
    calls = F.when(F.col("type") == "tool/result", F.array(F.concat(F.lit("c"), "step"), F.concat(F.lit("c"), F.col("step") % 3)))
    nodes = nodes.select("session_id", "group_id", "pos", "seq", "type", calls.alias("calls"), F.concat(F.lit('said "'), "chars", F.lit('"')).alias("text"))
    keys = ["session_id", "group_id"]
    seen = audits.first_seen(nodes, keys, ["pos"], "calls", "call_ids")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    groups = nodes.groupBy(*keys).agg(listed("seq").alias("seqs"), listed("type").alias("types"), listed("text").alias("texts")).join(seen, keys)
    return groups.select(*keys, lineage.group_fingerprint(F.col("session_id"), F.col("seqs"), F.col("call_ids"), F.col("types"), F.col("texts")).alias("fingerprint"))


def control_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of every session from frames that may come late or twice."""
    return control.latest(logs.control_frames(spark, sf_dir))


def control_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every host shows after its baselines and updates."""
    return control.mirror(logs.mirror_frames(spark, sf_dir))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows after all operations on them."""
    return audits.merged_audit(None, logs.audit_operations(spark, sf_dir))


def audit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every operation on an audit row came to."""
    return audits.operation_verdicts(logs.audit_operations(spark, sf_dir)).select("session_id", "request_id", "op_no", "op", "verdict")


def slot_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's state as text within 420 bytes and 120 tokens."""
    rows = slots.rendered(logs.slot_states(spark, sf_dir), 420, 120)
    return rows.select("session_id", "text", "truncated", "blocked", "tokens")


def slot_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of every session's state, and how."""
    states = slots.rendered(logs.slot_states(spark, sf_dir), *config.injection_budget(420.5, 120))
    visible = logs.slot_nodes(spark, sf_dir).where("own").select("session_id", "seq", F.col("pos").alias("generation"))
    return slots.slot_diagnostics(visible, states)


def slot_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What maintenance does with the slots of every session."""
    users = logs.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("event_id").alias("e"))
    wanted = users.select("session_id", F.when(F.col("session_id") % 11 == 0, "").otherwise(F.concat(F.lit("state "), F.col("e") % 2)).alias("text"))
    return slots.slot_decisions(logs.slot_nodes(spark, sf_dir), wanted, users.select("session_id", (F.col("e") % 6).alias("generation")))


def summary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the summaries of groups of ten events."""
    return checkpoints.summary_violations(*logs.summary_items(spark, sf_dir))


def entry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate entries with the ids that they keep or get, or why they can't stay."""
    return checkpoints.entry_verdicts(*logs.entry_lists(spark, sf_dir))


def merged_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited texts with the ids of entries of the same words."""
    candidates, base = logs.entry_lists(spark, sf_dir)
    return checkpoints.merged_edit(candidates.drop("id"), base)


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every session's entries."""
    _, base = logs.entry_lists(spark, sf_dir)
    return checkpoints.content_digest(base.withColumn("ordinal", F.substring("id", 2, 20).cast("long")))


def evidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every session to events that its fold held, and to others."""
    log = logs.authority_log(spark, sf_dir)
    return checkpoints.evidence_split(log.select("session_id", "seq"), log.where("type = 'todo/write'"))


def maintenance_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every session's total calls for in a window of 60,000 tokens."""
    return pressure.maintenance(logs.surface_of(logs.tool_log(spark, sf_dir)), config.resolve(config.Policy(), WINDOW))


def ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every session stands between threshold and exit, and what its slot costs."""
    log = logs.tool_log(spark, sf_dir)
    surface = logs.surface_of(log)
    shown = logs.slot_nodes(spark, sf_dir).withColumn("recorded", F.when(F.col("seq") % 3 > 0, F.col("seq") % 100))
    prices = surface.where("seq % 2 = 0").select("session_id", "seq", "tokens")
    priced = slots.visible_slot_tokens(shown, prices)
    return pressure.ledger_snapshot(surface, priced, replay.generations(logs.replaced_log(spark, sf_dir)), config.resolve(config.Policy(), WINDOW))


def pressure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one pressure pass over every session."""
    surface = logs.surface_of(logs.tool_log(spark, sf_dir))
    return pressure.pressure_ledger(surface, config.resolve(config.Policy(), WINDOW), cap=20_000)[0]


def pressure_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How one pressure pass ended for every session above the threshold."""
    surface = logs.surface_of(logs.tool_log(spark, sf_dir))
    return pressure.pressure_ledger(surface, config.resolve(config.Policy(), WINDOW), cap=20_000)[1]



def prune_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one prune pass appends: results over 6,000 characters before the recent zone, over 9,000 within it."""
    ends = reductions.log_ends(logs.tool_log(spark, sf_dir))
    rows = reductions.prune_rows(_zoned(spark, sf_dir), ends, threshold=6_000, hard_limit=9_000)
    return rows.select("session_id", "seq", "type", F.get("covers", F.lit(0)).alias("covered"), "tokens")


def _block_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(logs.block_results(spark, sf_dir), blocks=blocks.blocks_of(F.col("content"))).drop("content")


def block_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every message by both measures, and its tokens."""
    content = F.col("blocks")
    return _block_results(spark, sf_dir).select("session_id", "seq", blocks.measured(content, nested=False).alias("own_chars"), blocks.measured(content).alias("chars"), blocks.token_sum(content).alias("tokens"))


def block_prunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a prune pass over contents of many blocks appends."""
    results = _block_results(spark, sf_dir)
    rows = reductions.block_prunes(results, reductions.log_ends(results), threshold=1_500, hard_limit=3_000, head=700, tail=300)
    return rows.select("session_id", "seq", "type", F.get("covers", F.lit(0)).alias("covered"), "tokens", F.md5(blocks.written(F.col("blocks")).cast("binary")).alias("digest"))


def block_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that summaries of results of many blocks append, where they are cheaper."""
    results = _block_results(spark, sf_dir)
    texts = results.select("session_id", "seq", F.repeat(F.lit("summary "), (F.col("seq") % 90).cast("int")).alias("text")).where("seq % 9 <> 1")
    rows = reductions.block_summaries(results, texts, reductions.log_ends(results))
    return rows.select("session_id", "seq", "type", F.get("covers", F.lit(0)).alias("covered"), "tokens", F.md5(blocks.written(F.col("blocks")).cast("binary")).alias("digest"))


def group_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that summaries of tool results append, priced by the results' places."""
    log = logs.tool_log(spark, sf_dir)
    nodes = segments.with_segments(zones.with_cuts(logs.surface_of(log)))
    prices = nodes.select("session_id", "seq", (F.col("pos") * 37 % 1500 + 60).alias("price"))
    rows = reductions.group_rows(nodes, prices, reductions.log_ends(log))
    return rows.select("session_id", "seq", "type", F.get("covers", F.lit(0)).alias("covered"), "tokens")


def region_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a summary of every session's oldest batch appends, or its failure."""
    zoned = _zoned(spark, sf_dir)
    plans = zones.forget_batch(zoned, 4_000, 6_000).where("reason is null")
    spans = zoned.join(plans.select("session_id", "end_pos"), "session_id").where("pos <= end_pos")
    spans = spans.groupBy("session_id").agg(F.sort_array(F.collect_list("seq")).alias("covers"), F.sum("tokens").alias("tokens")).withColumn("price", F.col("session_id") % 7 * 900 + 100)
    rows = reductions.region_rows(spans, reductions.log_ends(logs.tool_log(spark, sf_dir)))
    return rows.select("session_id", "seq", "type", F.size("covers").cast("long").alias("n_covered"), "error")


def reentry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nodes on every session's surface may be folded again."""
    log = logs.replaced_log(spark, sf_dir)
    shown = replay.replay(log).select("session_id", "seq")
    return reductions.reentry_verdicts(replay.source_index(log).join(shown, ["session_id", "seq"]))


def tool_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool work that every session still owes before its recent zone."""
    zoned = _zoned(spark, sf_dir)
    groups = segments.tool_groups(zoned).withColumn("may_attempt", F.col("session_id") % 4 != 0)
    return reductions.tool_debt(zoned.where("zone <> 'recent'"), groups, 9_150)


def effective_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every session's fold goes on."""
    return reductions.effective_cursors(logs.cursor_records(spark, sf_dir))



def surface_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and prices that don't match, where every 97th price is lost, every 89th given twice and some belong to ended turns."""
    log = logs.tool_log(spark, sf_dir)
    prices = log.where("seq % 97 <> 0 and (type <> 'turn/end' or seq % 10 = 0)").select("session_id", "seq")
    return surfaces.misaligned(logs.surface_of(log), prices.unionByName(prices.where("seq % 89 = 0")))


def surface_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three position ranges of every session, of which one leaves the surface."""
    surface = logs.surface_of(logs.tool_log(spark, sf_dir))
    span = F.explode(F.array(*[F.struct(F.lit(i).alias("range_id"), F.lit(a).cast("long").alias("first"), F.lit(z).cast("long").alias("last")) for i, (a, z) in enumerate([(0, 9), (5, 30), (40, 100_000)])]))
    return surfaces.ranges(surface, surface.select("session_id").distinct().select("session_id", span.alias("s")).select("session_id", "s.*"))


def span_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether spans between every row and the sixth after it (or the second before it) may be replaced."""
    log = logs.tool_log(spark, sf_dir)
    asked = log.select("session_id", F.col("seq").alias("range_id"), F.col("seq").alias("start_seq"), (F.col("seq") + F.when(F.col("seq") % 70 == 3, -2).otherwise(6)).alias("end_seq"))
    return surfaces.span_reasons(zones.with_cuts(logs.surface_of(log)), asked)


def fold_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible events that wait above every session's cursor."""
    cursors = reductions.effective_cursors(logs.cursor_records(spark, sf_dir))
    return surfaces.backlog(logs.marker_log(spark, sf_dir), cursors)


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many audit rows of every session are of each class."""
    rows = logs.audit_log(spark, sf_dir).select("session_id", audits.classification().alias("classification"))
    return rows.groupBy("session_id", "classification").agg(F.count("*").alias("n"))


def pressure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pressure pass released in every session."""
    return surfaces.ledger_totals(pressure_ledger(spark, sf_dir))



QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, zone_partition, zone_partition_safe, pairing_balance, forget_batch_plan, pressure_span_plan, legacy_tail_split,
        retained_tail_floor, envelope_budget, prune_documents, bounded_text, tool_segments, segment_owners, tool_groups, group_chunks, eligible_spans, surface_replay, surface_generations, turns_after,
        source_index, provenance_digest, record_faults, replacement_coverage, reentry_sources, unrecorded_landings, evidence_counters, compaction_lock, event_filter, authority_views, view_carry, urgent_events, batch_window_count,
        batch_window_bytes, fold_windows, group_inputs, json_leaves, audit_timeline, audit_repair, audit_recovery, audit_attempts, served_seqs, landed_merge, attempt_gates, group_fingerprints, audit_rows, audit_operations, control_latest, control_mirror, slot_render, slot_diagnostics, slot_decisions, summary_violations,
        entry_verdicts, merged_edit, content_digest, evidence_split, maintenance_tiers, ledger_snapshot, pressure_ledger, pressure_outcomes,
        prune_pass, block_measures, block_prunes, block_summaries, group_replacements, region_replacements, reentry_verdicts, tool_debt, effective_cursors,
        surface_alignment, surface_ranges, span_checks, fold_backlog, audit_counts, pressure_totals,
    )
}
