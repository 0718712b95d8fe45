"""Views carried on, lists merged in order, and gates by what was known."""

import json

import pytest
from pyspark.sql import functions as F

from loomstrand.operators import audits, events
from loomstrand.sources import logs

LOG = "session_id long, seq long, type string, data string"


def goal(seq, **snapshot):
    data = {"operation": "set", "goal": snapshot} if snapshot else {"operation": "clear"}
    return (1, seq, "goal/change", json.dumps(data))


def todo(seq, *items):
    return (1, seq, "todo/write", json.dumps({"todos": [{"content": c, "status": s} if isinstance(s, str) else c for c, s in items]}))


@pytest.mark.parametrize("cuts", [[], [8], [3, 4, 20], [0, 1, 2, 5, 9, 14]])
def test_any_split_of_the_log_gives_the_same_views(spark, cuts):
    log = logs.authority_log(spark, "/root/testdata/sf0.001").cache()
    nothing = events.authority_views(log.limit(0)).withColumn("through", F.lit(-1).cast("long"))
    whole = {r.session_id: r for r in events.carried_views(nothing, log).collect()}
    plain = {r.session_id: r for r in events.authority_views(log).collect()}
    assert all((whole[s].goal, whole[s].todo) == (plain[s].goal, plain[s].todo) for s in plain)
    views = nothing
    for first, last in zip([-1, *cuts], [*cuts, 10**9], strict=True):
        # Each part begins with rows that the one before had already.
        views = events.carried_views(views, log.where((F.col("seq") > first - 3) & (F.col("seq") <= last)))
    assert {r.session_id: r for r in views.collect()} == whole


def test_phases_tombstones_and_lists_that_move(spark):
    def views(*rows):
        return events.carried_views(nothing, spark.createDataFrame(list(rows), LOG))

    nothing = events.authority_views(spark.createDataFrame([], LOG)).withColumn("through", F.lit(-1).cast("long"))
    before = views(goal(0, id="g", revision=1, phase="plan", objective="o"), todo(1, ("a", "done"), ("", "x"), (5, None), ("b", "")))
    held = before.collect()[0]
    assert held.goal.phase == "plan" and [tuple(i) for i in held.todo["items"]] == [("a", "done"), ("b", "pending")] and held.through == 1
    cases = [
        ([goal(5, id="g", revision=1, phase="plan", objective="o")], [], []), ([goal(5, id="g", revision=1, phase="build", objective="o")], ["goal"], []), ([goal(5)], ["goal"], ["goal"]),
        ([todo(5, ("a", "done"), ("b", "pending"))], [], []), ([todo(5, ("b", "pending"), ("a", "done"))], ["todo"], []), ([todo(5)], ["todo"], ["todo"]),
        ([goal(5), todo(6)], ["goal", "todo"], ["goal", "todo"]), ([(1, 5, "goal/change", '{"operation":"set"}'), (1, 6, "todo/write", "{}"), (1, 7, "other", None)], [], []), ([goal(1)], [], []),
    ]
    for rows, changed, cleared in cases:
        after = events.carried_views(before, spark.createDataFrame(rows, LOG))
        found = events.view_changes(before, after).collect()[0]
        assert (found.changed, found.cleared) == (changed, cleared), rows


def test_lists_are_merged_in_order_of_first_sight(spark):
    rows = [("k", 2, [1, None, 7]), ("k", 1, [3, 1, 3]), ("k", 3, None), ("k", 4, []), ("k", 2, [1, None, 7]), ("empty", 1, None), (None, 1, [2]), ("only nulls", 1, [None])]
    found = audits.first_seen(spark.createDataFrame(rows, "k string, o long, v array<long>"), ["k"], ["o"], "v")
    assert {r.k: list(r.merged) for r in found.collect()} == {"k": [3, 1, 7], "empty": [], None: [2], "only nulls": []}


def test_served_claims(spark):
    schema = "session_id long, request_id string, fingerprint string, status string, claims array<long>"
    rows = [(1, "a", "f", "success", [4, 5]), (1, "b", "f", "open", [5, 6]), (1, "c", "f", "aborted", [9]), (1, "d", "f", "open", None), (1, "e", "f", "repaired", None), (1, "f", "f", None, [8])]
    audit = spark.createDataFrame(rows, schema)
    assert sorted(r.seq for r in audits.served_seqs(audit).collect()) == [4, 5, 6]
    assert audits.landed_merge(audit).collect()[0].landed == [4, 5, 6, 9, 8]


def test_gates_in_order(spark):
    moment = lambda *rows: spark.createDataFrame([(1, "f", t) for t in rows], "session_id long, fingerprint string, time long")
    audit = lambda *rows: spark.createDataFrame([(1, "f", *r) for r in rows], "session_id long, fingerprint string, opened long, ended long, status string, attempt long, claims array<long>")

    def gates(asks, rows=(), landings=(), lost=()):
        found = audits.attempt_gates(moment(*asks), audit(*rows), moment(*landings), moment(*lost))
        return [r.gate for r in found.orderBy("time").collect()]

    assert gates([0, 10]) == ["owed", "owed"]
    assert gates([4, 5, 6], landings=[5]) == ["owed", "landed", "landed"]
    assert gates([1, 2, 3], lost=[1, 2]) == ["owed", "unwritten-exhausted", "unwritten-exhausted"]
    assert gates([1, 2, 9], [(1, 5, "failure", None, None), (2, 6, "failure", 1, [])]) == ["owed", "attempts-exhausted", "attempts-exhausted"]
    assert gates([1, 5, 7], [(1, 5, "success", 1, [])]) == ["owed", "served", "served"]
    assert gates([1, 5], [(1, 5, "failure", 1, [3])]) == ["served", "owed"]
    assert gates([2, 5, 6], [(1, 5, "fallback", 1, [])]) == ["owed", "refused", "refused"]
    assert gates([3], [(1, 2, "fallback", 0, []), (3, None, None, 1, [])]) == ["owed"]
    # Evidence goes before budgets, unwritten attempts before recorded ones.
    assert gates([9], [(1, 2, "failure", 2, [])], landings=[9], lost=[1, 2]) == ["landed"] and gates([9], [(1, 2, "failure", 2, [])], lost=[1, 2]) == ["unwritten-exhausted"]
    assert gates([5, 5], lost=[5, 5]) == ["unwritten-exhausted"] * 2


def test_slots_that_are_shown_and_what_they_cost(spark):
    from loomstrand.functions import blocks
    from loomstrand.operators import slots

    visible = spark.createDataFrame([(1, 4, 40, 7), (1, 2, 20, 9), (2, 0, 5, None), (3, 0, 6, 8)], "session_id long, pos long, seq long, recorded long")
    prices = spark.createDataFrame([(1, 40, 100), (3, 6, 55)], "session_id long, seq long, tokens long")
    assert {tuple(r) for r in slots.visible_slot_tokens(visible, prices).collect()} == {(1, 9), (2, 0), (3, 55)}
    contents = ['[{"type":"text","text":"x"}]', '[{"type":"text","text":"x"},{"type":"text","text":"y"}]', '[{"type":"image"}]', "[]", None]
    found = spark.createDataFrame([(c,) for c in contents], "c string").select(blocks.sole_text(blocks.blocks_of(F.col("c"))).alias("t")).collect()
    assert [r.t for r in found] == ["x", None, None, None, None]


def test_fold_limits():
    from loomstrand.plans import config

    assert config.FoldConfig("p", "m").max_events == 200
    for change in ({"provider": ""}, {"model": None}, {"min_events": 0}, {"max_events": 19}, {"timeout_ms": 2**31}, {"max_infra_retries": -1}, {"max_entry_bytes": 1.5}, {"max_list_items": True}):
        with pytest.raises(ValueError):
            config.FoldConfig(**({"provider": "p", "model": "m"} | change))
    assert config.FoldConfig("p", "m", max_infra_retries=0).max_infra_retries == 0
    with pytest.raises(TypeError):
        config.FoldConfig("p", "m", unknown=1)
    assert config.injection_budget(0.5) == (1, 512) and config.injection_budget(800.9, 0) == (800, 1)
    assert [config.capped_group_tokens(100, c) for c in (None, 50, -3, 200)] == [100, 50, 0, 100]


def test_prune_budgets():
    from loomstrand.plans.config import PruneConfig

    assert PruneConfig().hard_limit is None and PruneConfig(hard_limit=8192).threshold == 8192
    for change in ({"threshold": 0}, {"head": -1}, {"tail": 1.0}, {"head": 8_000}, {"hard_limit": 8_191}, {"hard_limit": 0}, {"threshold": True}):
        with pytest.raises(ValueError):
            PruneConfig(**change)
