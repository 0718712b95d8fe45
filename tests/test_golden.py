"""Values that the operators must give on small hand-made sessions."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstrand.functions import budgets, text
from loomstrand.operators import audits, checkpoints, events, reductions, replay, segments, slots, surfaces, zones
from loomstrand.plans import config, pressure

SURFACE = "session_id long, pos long, seq long, type string, turn long, step long, tool_calls long, chars long, tokens long"


def surface(spark, nodes, session=1):
    """nodes: (type, turn, step, tool_calls, chars, tokens)."""
    return spark.createDataFrame([(session, i, i, *n) for i, n in enumerate(nodes)], SURFACE)


def user(tokens):
    return ("user/message", None, None, 0, 0, tokens)


def steps(n, tokens, turn=1):
    return [("assistant/message", turn, i, 0, 0, tokens) for i in range(n)]


def call(step, tokens, calls=1, turn=1):
    return ("assistant/message", turn, step, calls, 0, tokens)


def result(step, tokens, chars=6000, turn=1):
    return ("tool/result", turn, step, 0, chars, tokens)


def one(df):
    return df.collect()[0]


def test_call_budget(spark):
    budget = lambda t, s: one(spark.range(1).select(budgets.call_budget(F.lit(t).cast("long"), F.lit(s).cast("long"), window=100, reserve=20, margin=10, instruction=10, checkpoint=10, tail=20, tail_min=15).alias("b"))).b
    assert budget(130, 90) == (40, 30, 20, 10, False)
    assert budget(100, 40) == (60, 10, 15, 0, True)
    assert budget(50, 90)[:2] == (0, 70)


def test_zone_budget(spark):
    budget = lambda t, s: one(spark.range(1).select(budgets.zone_budget(F.lit(t).cast("long"), F.lit(s).cast("long"), waterline=70, pressure=80, forget=50, tail=20, tail_min=12).alias("b"))).b
    assert budget(70, 30) == (40, 30, 30, 20, 0, False)
    assert budget(90, 25)[1:5] == (5, 5, 12, 20)
    assert budget(30, 30)[1:4] == (70, 50, 20)
    assert budget(80, 12).dominated and not budget(79, 13).dominated


def test_tail_floor(spark):
    nodes = surface(spark, [("assistant/message", t, None, 0, 0, 10) for t in (1, 2, 2, 3, None)])
    log = spark.createDataFrame([], "session_id long, seq long, type string, turn long, reason string")
    assert one(zones.retained_tail_floor(nodes, log)).tokens == 40


def zoned(spark, nodes, recent, forget):
    return zones.with_zones(zones.with_cuts(surface(spark, nodes)), recent, forget)


def test_zones_of_twelve_steps(spark):
    totals = {r.zone: (r.first_pos, r.tokens) for r in zones.zone_totals(zoned(spark, steps(12, 10), 20, 50)).collect()}
    assert totals == {"forget": (0, 70), "tool": (7, 30), "recent": (10, 20)}


@pytest.mark.parametrize(
    "reclaim,cap,least,expected",
    [(40, 80, 10, (0, 5, 60, None)), (1000, 50, 10, (0, 4, 50, None)), (40, 0, 10, (None, None, None, "envelope-dominated")), (40, 50, 50, (None, None, None, "span-below-minimum"))],
)
def test_pressure_spans(spark, reclaim, cap, least, expected):
    assert tuple(one(zones.pressure_span(zoned(spark, steps(12, 10), 20, 50), reclaim=reclaim, cap=cap, least=least)))[1:] == expected


def test_absolute_boundaries_keep_the_last_token(spark):
    prices = [10, 10, 25180]
    starts = one(zoned(spark, [user(p) for p in prices], 25181, 25181).agg(F.max("recent_start").alias("r"))).r
    assert starts == 1


def test_batches_too_large(spark):
    plan = one(zones.forget_batch(zoned(spark, [user(30)] * 3, 0, 0), 20, 24))
    assert plan.reason == "oldest-unit-too-large" and plan.end_pos is None
    assert one(zones.forget_batch(zoned(spark, [user(30)] * 3, 500, 500), 20, 24)).reason == "no-forget-range"


def test_spans_of_users(spark):
    span = lambda nodes, recent=0, **more: tuple(one(zones.pressure_span(zoned(spark, nodes, recent, recent), **more)))[1:]
    users = [user(10)] * 12
    assert span(users, reclaim=20, cap=200, least=10) == (0, 3, 40, None)
    assert span(users, reclaim=1000, cap=60, least=10) == (0, 5, 60, None)
    assert span([user(10), call(1, 10), result(1, 10), user(10), user(10), user(10)], reclaim=15, cap=200, least=0) == (0, 2, 30, None)
    assert span([user(10)] * 5, reclaim=1, cap=200, least=100)[3] == "span-below-minimum"
    assert span([user(10)] * 5, recent=50, reclaim=1, cap=200, least=0)[3] == "no-safe-prefix"
    assert span([("assistant/message", 1, 1, 0, 0, 10)] * 3, reclaim=100, cap=25, least=0)[3] == "no-safe-prefix"


def test_zone_with_a_pair_across_the_boundary(spark):
    nodes = [user(10), call(1, 10), result(1, 10), user(10), call(2, 10, turn=2), result(2, 10, turn=2)]
    starts = one(zoned(spark, nodes, 10, 30).agg(F.max("recent_start").alias("r"), F.max("forget_start").alias("f")))
    assert tuple(starts) == (4, 3)


def test_corrupt_pairing_is_told(spark):
    assert all(r.corrupt for r in zones.pairing_balance(surface(spark, [result(1, 5), call(2, 5)])).collect())


def chunks(spark, nodes, cap):
    cut = zones.with_cuts(surface(spark, [user(1), *nodes]))
    return sorted((r.start_pos, r.end_pos, r.tokens) for r in segments.totals(segments.with_chunks(segments.with_segments(cut), cap), "segment", "chunk").collect())


def test_chunks(spark):
    pairs = lambda n, c, r: [x for i in range(n) for x in (call(i, c), result(i, r))]
    assert chunks(spark, pairs(3, 6000, 6000), 12000) == [(1, 2, 12000), (3, 4, 12000), (5, 6, 12000)]
    assert chunks(spark, pairs(1, 6000, 6000), 5000) == [(1, 2, 12000)]
    assert chunks(spark, pairs(2, 100, 11000), 12000) == [(1, 2, 11100), (3, 4, 11100)]
    mixed = [call(0, 100), result(0, 11000), call(1, 100, 2), result(1, 11000), result(1, 11000), call(2, 100), result(2, 11000)]
    assert chunks(spark, mixed, 12000) == [(1, 2, 11100), (3, 5, 22100), (6, 7, 11100)]


def test_eligible_spans(spark):
    nodes = [user(1), *[x for i in range(4) for x in (call(i, 100), result(i, 2000))]]
    cut = segments.with_segments(zones.with_cuts(surface(spark, nodes))).withColumn("eligible", F.col("pos") > 4)
    assert [(r.start_pos, r.end_pos) for r in segments.eligible_spans(cut).collect()] == [(5, 8)]
    parallel = [user(1), call(0, 1, 2), result(0, 1), result(0, 1)]
    cut = segments.with_segments(zones.with_cuts(surface(spark, parallel))).withColumn("eligible", F.col("pos") == 3)
    assert segments.eligible_spans(cut).count() == 0


@pytest.mark.parametrize("value,limit,kept", [("abc", 3, "abc"), ("任务状态任务状态", 10, "任务…"), ("任务状态", 3, "…"), ("é😀é", 7, "é…"), ("ab😀cdef", 9, "ab😀…"), ("", 3, "")])
def test_bounded(spark, value, limit, kept):
    got = one(spark.createDataFrame([(value,)], "t string").select(text.bounded("t", limit).alias("b"))).b
    assert got == kept and len(got.encode()) <= limit


def test_bounded_needs_room():
    with pytest.raises(ValueError):
        text.bounded("t", 2)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40), st.integers(3, 40))
def test_bounded_is_the_longest_prefix(spark, values, limit):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", text.bounded("t", limit).alias("b")).collect()
    for i, got in rows:
        whole = values[i]
        best = whole if len(whole.encode()) <= limit else max((whole[:n] for n in range(len(whole) + 1) if len(whole[:n].encode()) <= limit - 3), key=len) + "…"
        assert got == best


def test_token_estimate_and_trim(spark):
    estimate = lambda t: one(spark.createDataFrame([(t,)], "t string").select(text.token_estimate("t").alias("n"))).n
    assert [estimate(t) for t in ("", "abcde", "任务", "😀😀", "𠀀")] == [8, 10, 10, 9, 9]
    assert one(spark.createDataFrame([(" \t x  ",)], "t string").select(text.trimmed("t").alias("t"), text.is_blank("t").alias("b"))) == ("x", False)
    assert one(spark.createDataFrame([("```json\n{}\n```",)], "t string").select(text.without_fence("t").alias("t"))).t == "{}"


LOG = "session_id long, seq long, type string, covers array<long>, source_kind string, reason string, shadow long"


def splice(rows):
    """A naive list splice, as brute force for the replay."""
    shown = []
    for seq, kind, covers in rows:
        if covers:
            at = shown.index(covers[0])
            shown = [x for x in shown if x not in covers]
            shown.insert(at, seq)
        elif kind in replay.SEEN:
            shown.append(seq)
    return shown


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(1, 4)), min_size=1, max_size=30))
def test_replay_is_a_splice(spark, moves):
    rows = []
    for seq, (what, at, many) in enumerate(moves):
        shown = splice(rows)
        if what == 3 and shown:
            at %= len(shown)
            rows.append((seq, "user/message", shown[at : at + many]))
        else:
            rows.append((seq, ["user/message", "turn/end", "tool/result"][what % 3], []))
    df = spark.createDataFrame([(1, s, t, c, None, None, None) for s, t, c in rows], LOG)
    assert [r.seq for r in replay.replay(df).orderBy("pos").collect()] == splice(rows)


def test_sources_and_locks(spark):
    rows = [(0, "tool/result", []), (1, "compaction/prune", []), (2, "tool/result", [0]), (3, "tool/result", [2]), (4, "user/message", [3])]
    df = spark.createDataFrame([(1, s, t, c, "checkpoint" if s == 4 else None, None, 0 if s == 1 else None) for s, t, c in rows], LOG)
    assert {r.seq: r.kind for r in replay.source_index(df).collect()} == {0: "original", 2: "tool-pruned", 3: "unknown-replacement", 4: "history-summary"}
    assert tuple(one(replay.evidence_counters(df)))[1:] == (0, 1, 0)
    lock = spark.createDataFrame([(1, 0, "compaction/start", 1), (1, 1, "compaction/start", 2), (1, 2, "compaction/end", 2), (1, 3, "compaction/end", 9)], "session_id long, seq long, type string, lock_id long")
    assert tuple(one(replay.newest_lock(lock))) == (1, 0, 1)


def test_audit_rows(spark):
    rows = [(1, "b", 5, None, None, 3), (1, "a", 5, "failure", "BUDGET", 2), (1, "c", 1, "success", None, 2), (1, "d", 9, "failure", "ABORTED", 2), (1, "e", 9, "failure", "X", 2)]
    audit = spark.createDataFrame(rows, "session_id long, request_id string, time long, outcome string, code string, revision long")
    assert [(r.request_id, r.classification) for r in audits.timeline(audit).orderBy("place").collect()] == [("c", "committed"), ("a", "terminal-infeasible"), ("b", "aborted"), ("d", "aborted"), ("e", "transient-failure")]
    assert tuple(one(audits.certified_and_repairable(audit))) == (1, 2, "b")


def test_event_projection(spark):
    rows = [
        (0, "user/message", '{"source":{"kind":"user"},"content":[{"type":"text","text":"hi"},{"type":"text","text":" "},{"type":"text","text":"you"}]}'),
        (1, "user/message", '{"source":{"kind":"plugin"},"content":[{"type":"text","text":"no"}]}'),
        (2, "assistant/message", '{"interrupted":true,"message":{"content":[{"type":"text","text":"cut"}]}}'),
        (3, "assistant/message", '{"message":{"content":[{"type":"text","text":"done"}]}}'),
        (4, "compaction/summary", "{}"),
        (5, "todo/write", "not json"),
        (6, "turn/end", '{"reason":{"kind":"completed"}}'),
        (7, "command/run", '{"name":"rm"}'),
        (8, "goal/change", None),
    ]
    log = spark.createDataFrame([(1, *r) for r in rows], "session_id long, seq long, type string, data string")
    found = {r.seq: (r.kind, r.text) for r in events.projected(log).collect()}
    assert found.keys() == {0, 3, 6} and found[0] == ("user", "hi\nyou") and found[3] == ("assistant", "done") and found[6][0] == "turn/end"


def test_projected_fields_and_cuts(spark):
    rows = [
        (0, "tool/call", '{"name":"' + "n" * 300 + '","callId":"c","arguments":"{\\"a\\":{\\"b\\":[1.0,true,null]},\\"t\\":\\"' + "é" * 300 + '\\"}"}'),
        (1, "tool/call", '{"arguments":"{broken"}'),
        (2, "tool/result", '{"message":{"content":[{"type":"tool-result","toolCallId":"c","isError":true,"content":[{"type":"text","text":"out"}]}]},"error":{"name":"E"},"meta":{"x":1}}'),
        (3, "tool/result", '{"message":{"content":[{"type":"text","text":"no block of a result"}]}}'),
        (4, "goal/change", '{"operation":"clear","cleared":{"id":"g","revision":3}}'),
        (5, "goal/change", '{"operation":"set","goal":{"id":"g","revision":2,"phase":"active","objective":"o","maxGoalRounds":4,"blockedReason":{"code":"B"}},"roundsStarted":1}'),
        (6, "request/header", '{"reason":"series","header":{"config":{"provider":"p","model":"m"}}}'),
        (7, "request/header", '{"reason":"resume","header":{"config":{"provider":"p","model":"m"}}}'),
        (8, "plan/mode", "{}"),
        (9, "todo/write", '{"todos":[]}'),
        (10, "compaction/end", '{"compactionId":"z","error":" "}'),
        (11, "turn/end", '{"turn":2,"reason":{"kind":"aborted"}}'),
        (12, "command/run", '{"commandId":"r","name":"compact"}'),
        (13, "tool/call", "[1]"),
    ]
    log = spark.createDataFrame([(1, *r) for r in rows], "session_id long, seq long, type string, data string")
    found = {r.seq: r for r in events.projected(log).collect()}
    fields = {seq: json.loads(r.fields) for seq, r in found.items()}
    assert found.keys() == {0, 1, 2, 4, 5, 7, 8, 9, 10, 11, 12}
    assert json.loads(fields[0]["arguments"]) == {"a.b[0]": "1", "a.b[1]": "true", "t": "é" * 198 + "…"}
    assert [tuple(c) for c in found[0].truncation] == [("tool/call.name", 200, 200), ("t", 400, 399)]
    assert fields[1] == {"kind": "tool/call", "name": "", "callId": "", "arguments": "{broken"}
    assert fields[2] == {"kind": "tool/result", "callId": "c", "isError": True, "text": "out", "error": {"name": "E"}, "meta": '{"meta.x":"1"}'}
    assert fields[4] == {"kind": "goal/change", "operation": "clear", "clearedId": "g", "clearedRevision": 3}
    assert fields[5]["goal"] == {"id": "g", "revision": 2, "phase": "active", "objective": "o", "maxGoalRounds": 4, "roundsStarted": 1, "blockedReason": "B"}
    assert fields[8] == {"kind": "plan/mode", "active": False} and fields[9] == {"kind": "todo/write", "status": "cleared", "todos": []}
    assert fields[10] == {"kind": "compaction/end", "compactionId": "z"} and fields[11]["reason"] == {"kind": "aborted", "reason": {"kind": "unknown"}}
    assert fields[12] == {"kind": "command/run", "commandId": "r", "name": "compact"}


def test_backlog_counts_what_is_kept_and_leaves_slots_out(spark):
    said = '"content":[{"type":"text","text":"x"}]'
    rows = [(1, 0, "user/message", f'{{"source":{{"kind":"user"}},{said}}}'), (1, 1, "user/message", f'{{"source":{{"kind":"plugin"}},{said}}}'), (1, 2, "user/message", f'{{"source":{{"kind":"slot"}},{said}}}'), (1, 3, "other", "{}"), (2, 0, "plan/mode", "{}")]
    log = spark.createDataFrame(rows, "session_id long, seq long, type string, data string")
    cursors = spark.createDataFrame([(1, -1), (2, 0), (3, -1)], "session_id long, cursor long")
    assert {tuple(r) for r in surfaces.backlog(log, cursors).collect()} == {(1, 1, 1), (2, 0, 0), (3, 0, 0)}


def test_byte_windows(spark):
    df = spark.createDataFrame([(1, i, "user/message", "user", "x" * 1000) for i in range(4)] + [(2, 0, "user/message", "user", "y" * 9000)], "session_id long, seq long, type string, kind string, text string")
    got = {r.session_id: (r.outcome, r.n, r.source_cursor) for r in events.byte_windows(df, 20, 2500).collect()}
    assert got == {1: ("window", 2, 1), 2: ("infeasible", 0, None)}


def test_json_leaves(spark):
    raw = '{"a":{"b":[1,true,null,"x"," "]},"long":[0,1,2,3,4,5,6,7,8,9],"bin":"QUJDREVGR0hJSktMTU5PUA==","d":{"d":{"d":{"d":{"d":{"d":{"d":1}}}}}}}'
    leaves = one(events.json_leaves(spark.createDataFrame([(raw,)], "j string"), "j")).leaves
    assert leaves["a.b[0]"] == "1" and leaves["a.b[1]"] == "true" and leaves["a.b[3]"] == "x" and leaves["long[8…]"] == "…" and "long[8]" not in leaves
    assert "bin" not in leaves and "a.b[2]" not in leaves and any(k.endswith("…") and k.startswith("d.d") for k in leaves)
    assert one(events.json_leaves(spark.createDataFrame([("{bad",)], "j string"), "j")).leaves == {}


def test_slot_texts(spark):
    schema = "session_id long, goal struct<status: string, goal_id: string, revision: bigint, phase: string, objective: string>, todo struct<status: string, source_seq: bigint, items: array<struct<content: string, status: string>>>, facts array<string>, decisions array<string>, constraints array<string>, risks array<string>, revision long, source_cursor long, high_water long, digest string"
    row = (1, ("current", "g", 2, None, "ship it"), ("current", 7, [("a", "done"), ("b", "pending")]), ["f1", "f2"], [], [], ["r"], 4, 9, 9, "dg")
    df = spark.createDataFrame([row], schema)
    full = "\n".join(["Durable task state (revision 4, source event 9, digest dg).", "Current goal: ship it", "Goal identity: goal g, revision 2", "TODO list (session event 7):", "- [done] a", "- [pending] b", "", "Facts:", "- f1", "- f2", "Risks:", "- r"])
    got = one(slots.rendered(df, 5000, 5000))
    assert got.text == full and not got.truncated and not got.blocked
    nowhere = spark.createDataFrame([(1, ("current", "g", 2, "build", "ship it"), ("current", None, row[2][2]), *row[3:])], schema)
    assert one(slots.rendered(nowhere, 5000, 5000)).text == full.replace("revision 2\n", "revision 2, phase build\n").replace(" (session event 7)", "")
    head = "\n".join(full.split("\n")[:6])
    for budget in range(1, len(full) + 120, 9):
        got = one(slots.rendered(df, budget, 5000))
        assert len(got.text.encode()) <= budget and (got.text == "" or got.text.startswith(head)) and got.blocked == (got.text == "")
    assert one(slots.rendered(df, len(head.encode()) - 1, 5000)).blocked


def test_edits(spark):
    current = spark.createDataFrame([(1, "e1", "fact", "x"), (1, "e2", "fact", "x")], "session_id long, id string, kind string, content string")
    edited = spark.createDataFrame([(1, "fact", 0, "x"), (1, "fact", 1, "x"), (1, "fact", 2, "x")], "session_id long, kind string, ordinal long, content string")
    rows = checkpoints.merged_edit(edited, current).orderBy("ordinal").collect()
    assert [r.kept for r in rows] == [True, True, False] and len({r.id for r in rows}) == 3
    edits = spark.createDataFrame([(1, 3, True), (2, 3, True), (3, 3, False), (4, 3, True)], "session_id long, revision long, valid boolean")
    now = spark.createDataFrame([(1, 3), (2, 4), (3, 3)], "session_id long, revision long")
    assert {r.session_id: (r.outcome, r.revision) for r in checkpoints.edit_outcomes(edits, now).collect()} == {1: ("ok", 4), 2: ("conflict", None), 3: ("invalid", None), 4: ("not-found", None)}
    bad = spark.createDataFrame([(1, "a", " x"), (1, "b", ""), (1, "c", "x"), (1, "c", "y")], "session_id long, id string, content string")
    assert {(r.id, r.reason) for r in checkpoints.entry_violations(bad).collect()} == {("a", "untrimmed"), ("b", "blank"), ("c", "duplicate-id")}


def test_policies(spark):
    spec = config.resolve(config.Policy(), 100_000)
    assert (spec.threshold, spec.exit) == (80_000, 70_000)
    assert config.resolve(config.overridden(config.Policy(), forget_maintenance_ratio=0.75), 100_000).exit == 75_000
    for change in ({"recent_ratio": 0.6}, {"pressure_exit_ratio": 0.8}, {"target_batch_tokens": 30_000}, {"pressure_ratio": 1.2}, {"max_batch_tokens": -1}, {"tool_maintenance_ratio": 0.1}):
        with pytest.raises(ValueError):
            config.overridden(config.Policy(), **change)
    with pytest.raises(TypeError):
        config.overridden(config.Policy(), unknown=1)
    for window in (0, 9000, True):
        with pytest.raises(ValueError):
            config.resolve(config.Policy(), window)
    targets = spark.createDataFrame([("p", "m"), ("p", "n")], "provider string, model string")
    overrides = spark.createDataFrame([("p", "m", 0.9, None)], "provider string, model string, pressure_ratio double, recent_ratio double")
    assert sorted(tuple(r) for r in config.resolve_policies(targets, overrides, config.Policy()).collect()) == [("p", "m", 0.9, 0.2), ("p", "n", 0.8, 0.2)]
    assert config.duplicate_overrides(overrides.union(overrides)).count() == 1


def brute_pressure(nodes, spec, cap):
    """One session, step by step: nodes are (tokens, summary)."""
    batches, total = [], sum(t for t, _ in nodes)
    while len(batches) < spec.policy.max_pressure_batches and total > spec.exit:
        start = next((i for i, (_, s) in enumerate(nodes) if not s), len(nodes))
        suffix, recent = 0, 0
        for i in range(len(nodes) - 1, -1, -1):
            suffix += nodes[i][0]
            if suffix >= spec.retain:
                recent = i
                break
        best, run = None, 0
        for i in range(start, recent):
            run += nodes[i][0]
            if run > cap:
                break
            best = (start, i, run)
            if run >= total - spec.exit + 1:
                break
        if best is None:
            return batches, "no-safe-prefix"
        nodes = nodes[: best[0]] + [(best[2] // 10 + 50, True)] + nodes[best[1] + 1 :]
        before, total = total, sum(t for t, _ in nodes)
        batches.append((*best, before, total))
        if total >= before or (before - total < 1024 and (before - total) / best[2] < 0.15):
            return batches, "no-progress" if total >= before else "low-yield"
    return batches, "pressure-exit" if total <= spec.exit else "batch-limit"


@pytest.mark.parametrize("cap", [900, 4000, 50_000])
def test_pressure_loop_against_brute_force(spark, cap):
    spec = config.resolve(config.overridden(config.Policy(), max_pressure_batches=3, response_reserve_tokens=100, safety_margin_tokens=0), 20_000)
    sessions = {1: [500] * 40, 2: [100 + 37 * i % 900 for i in range(60)], 3: [300] * 10, 4: [5000] * 4, 5: [30] * 700}
    df = None
    for s, prices in sessions.items():
        part = surface(spark, [user(p) for p in prices], s)
        df = part if df is None else df.unionByName(part)
    ledger, outcomes = pressure.pressure_ledger(df, spec, cap)
    got = {}
    for r in ledger.orderBy("session_id", "batch").collect():
        got.setdefault(r.session_id, []).append((r.start_pos, r.end_pos, r.span_tokens, r.before_tokens, r.after_tokens))
    ends = {r.session_id: r.outcome for r in outcomes.collect()}
    for s, prices in sessions.items():
        if sum(prices) >= spec.threshold:
            batches, end = brute_pressure([(p, False) for p in prices], spec, cap)
            assert got.get(s, []) == batches and ends[s] == end
        else:
            assert s not in ends


def test_fences_and_terminal_verdicts(spark):
    attempts = spark.createDataFrame([(1, "a", 2, [4, 5]), (1, "b", 1, [4, 5]), (1, "c", 2, [4]), (9, "d", 2, [4])], "session_id long, request_id string, generation long, seqs array<long>")
    now = spark.createDataFrame([(1, 2, [4, 5])], "session_id long, generation long, seqs array<long>")
    assert {r.request_id: r.reason for r in surfaces.commit_fences(attempts, now).collect()} == {"a": None, "b": "generation-changed", "c": "source-changed", "d": "session-changed"}
    rows = [(1, "quarantined", 5, "g"), (2, "quarantined", 4, "g"), (3, "block", 4, "g"), (4, "block", 5, "g"), (5, "block", 4, "old"), (6, "block", 4, "held"), (7, "else", 4, "g")]
    verdicts = spark.createDataFrame(rows, "session_id long, kind string, cursor long, generation string")
    records = spark.createDataFrame([(i, 4, "held", "held" if i == 6 else "g") for i in range(1, 8)], "session_id long, now long, held string, generation_now string")
    found = {r.session_id: r.reason for r in surfaces.terminal_verdicts(verdicts, records).collect()}
    assert found == {1: None, 2: "cursor-not-advanced", 3: None, 4: "block-moves-cursor", 5: "stale-generation", 6: "restated", 7: "unknown-kind"}


def test_range_modes_lifecycles_and_summaries(spark):
    rows = spark.createDataFrame([("all", 9), ("none", 1), ("range", 2), ("range", 9), (None, 2)], "mode string, pos long")
    assert [r.ok for r in rows.select(surfaces.in_older_range(F.col("mode"), F.col("pos"), F.lit(1), F.lit(3)).alias("ok")).collect()] == [True, False, True, False, False]
    audit = spark.createDataFrame([(1, 5, None), (1, 5, "x"), (1, None, None), (2, 7, "y")], "session_id long, created_at long, cwd string")
    identities = spark.createDataFrame([(1, 5, None), (2, 7, "y"), (3, None, None)], "session_id long, created_at long, cwd string")
    assert sorted(tuple(r)[:2] for r in reductions.of_lifecycle(audit, identities).collect()) == [(1, 5), (2, 7)]
    item = spark.createDataFrame([("ok", ["a", "b"], [], [], ["u"], 7)], "s string, f array<string>, p array<string>, e array<string>, u array<string>, q long")
    made = one(item.select(reductions.summary_text(F.col("s"), F.col("f"), F.col("p"), F.col("e"), F.col("u"), F.col("q")).alias("t"))).t
    assert made == "[tool group summary]\nResult: ok\nFacts: a; b\nFiles: (none)\nErrors: (none)\nUnresolved: u\nSource event: seq=7\n[/tool group summary]"
    kinds = spark.createDataFrame([(1, 0, "history-summary"), (1, 1, "history-summary"), (1, 2, "original"), (2, 0, "original")], "session_id long, pos long, kind string").withColumns({"first_pos": F.lit(0), "last_pos": F.lit(1)})
    assert {r.session_id: r.isolated for r in reductions.isolated_summary(kinds).collect()} == {1: True, 2: False}


def test_requests_and_missing_events(spark):
    log = spark.createDataFrame([(1, 0, "request/header"), (1, 3, "request/header"), (1, 4, "user/message")], "session_id long, seq long, type string")
    spans = spark.createDataFrame([(1, 1, 9), (1, 0, 4)], "session_id long, pos long, seq long")
    assert tuple(one(surfaces.newest_header_and_span(log, spans))) == (1, 3, [4, 9])
    assert [tuple(r) for r in surfaces.missing_events(spans, log).collect()] == [(1, 9)]


def test_hostile_and_mixed_payloads(spark):
    deep, deepest, huge = "[" * 5_000 + "]" * 5_000, "[" * 300_000 + "]" * 300_000, "9" * 400
    result = '"message":{"content":[{"type":"tool-result","toolCallId":"c","isError":true,"content":["x",{"type":"text","text":"out"},7]}]}'
    rows = [
        (0, "tool/call", "{'name':'x'}"),
        (1, "tool/call", json.dumps({"name": "n", "arguments": deepest})),
        (16, "tool/call", json.dumps({"name": "n", "arguments": deep})),
        (2, "tool/call", json.dumps({"name": 5, "callId": "c", "arguments": f'{{"n":{huge},"m":-{huge},"e":1e-7,"s":1e22}}'})),
        (3, "user/message", '{"source":{"kind":"user"},"content":["loose",{"type":"text","text":"hi"},3,{"type":"text","text":4}]}'),
        (4, "todo/write", '{"todos":["loose",{"content":"a","status":"done"},{"content":5}]}'),
        (5, "todo/write", '{"todos":"none"}'),
        (6, "tool/result", f'{{{result},"meta":{{"n":{huge}}}}}'),
        (7, "tool/result", '{"meta":' + deep + "}"),
        (8, "turn/end", '{"turn":3,"reason":null}'),
        (9, "tool/result", '{"message":{"content":[{"type":"text","isError":true}]},"meta":{"a":1}}'),
        (10, "goal/change", '{"operation":"set","goal":{"id":7,"revision":1.5,"phase":"p","objective":null}}'),
        (11, "assistant/message", '{"message":"no record"}'),
        (12, "user/message", '{"source":{"kind":"user"},"content":"plain"}'),
        (13, "plan/mode", '{"active":"true"}'),
        (14, "plan/mode", "   "),
        (15, "command/run", '{"name":"goal","commandId":1,"args":"' + "é" * 300 + '"}'),
    ]
    log = spark.createDataFrame([(1, *r) for r in rows], "session_id long, seq long, type string, data string")
    found = {r.seq: r for r in events.projected(log).collect()}
    fields = {seq: json.loads(r.fields) for seq, r in found.items()}
    assert found.keys() == {1, 2, 3, 4, 6, 8, 9, 10, 13, 15, 16} == {r.seq for r in events.kept_events(log).collect()}
    assert found[1].truncation[0].path == "tool/call.arguments" and fields[1]["arguments"].startswith("[[[")
    assert json.loads(fields[16]["arguments"]) == {"[0]" * 7 + "…": "…"}
    assert fields[2]["name"] == "" and json.loads(fields[2]["arguments"]) == {"n": "Infinity", "m": "-Infinity", "e": "1e-7", "s": "1e+22"}
    assert fields[3] == {"kind": "user", "text": "hi"}
    assert fields[4]["todos"] == [{"content": "", "status": ""}, {"content": "a", "status": "done"}, {"content": "", "status": ""}]
    assert fields[6]["text"] == "out" and fields[6]["isError"] and fields[6]["meta"] == '{"meta.n":"Infinity"}'
    assert fields[8] == {"kind": "turn/end", "turn": 3, "reason": None} and fields[9]["isError"] and fields[9]["callId"] == ""
    assert fields[10]["goal"] == {"phase": "p", "objective": ""} and fields[13] == {"kind": "plan/mode", "active": False}
    assert [tuple(t) for t in found[15].truncation] == [("command/run.args", 400, 399)]
    assert all(r.leaves == {} or r.leaves for r in events.json_leaves(spark.createDataFrame([(deepest,), (huge,)], "j string"), "j").collect())
