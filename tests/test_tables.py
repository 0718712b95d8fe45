"""Keyed tables: merges by batch, by stream, and against other writers."""

import os

import pytest
from pyspark.sql import functions as F

from loomstrand.operators import audits
from loomstrand.sources import keyed, logs
from loomstrand.streaming import control
from loomstrand.streaming.tables import merge_stream

SF = "/root/testdata/sf0.001"
OPS = "session_id long, request_id string, op_no long, op string, created_at long, cwd string, revision long, outcome string, end_revision long, end_cursor long, stable_revision long, stable_cursor long"
KEYS = ("session_id", "request_id")


def op(no, kind, outcome=None, request="q", created=7, cwd="d", revision=3, end=(3, 9), stable=(3, 9)):
    return (1, request, no, kind, created, cwd, revision, outcome, *end, *stable)


def verdicts(spark, rows):
    found = audits.operation_verdicts(spark.createDataFrame(rows, OPS)).orderBy("request_id", "op_no")
    return [r.verdict for r in found.collect()]


def test_settled_rows_stay_but_for_a_late_success_after_a_repair(spark):
    rows = [op(0, "open"), op(1, "settle", "repair"), op(2, "finish", "failure"), op(3, "settle", "success"), op(4, "finish", "success"), op(5, "finish", "repair"), op(6, "open")]
    assert verdicts(spark, rows) == ["opened", "settled", "already-settled", "already-settled", "repair-replaced", "already-settled", "already-open"]
    done = audits.merged_audit(None, spark.createDataFrame(rows, OPS)).collect()
    assert [tuple(r) for r in done] == [(1, "q", 7, "d", 3, "success", 3, 9)]


def test_fences_of_a_repair(spark):
    rows = [
        op(0, "settle", "repair"), op(1, "open"), op(2, "settle", "repair", created=8), op(3, "settle", "repair", cwd=None), op(4, "settle", "failure", stable=(4, 9)),
        op(5, "settle", "repair", end=(3, 8)), op(6, "settle", "success", end=(2, 9)), op(7, "settle"), op(8, "settle", "failure", end=(1, 1)),
    ]
    assert verdicts(spark, rows) == ["missing-key", "opened", "other-lifecycle", "other-lifecycle", "other-revision", "uncertified", "uncertified", "no-outcome", "settled"]


def test_any_split_of_the_operations_gives_the_same_table(spark, tmp_path):
    operations = logs.audit_operations(spark, SF).cache()
    whole = sorted(map(str, audits.merged_audit(None, operations).collect()))
    for parts in (2, 5):
        store = keyed.KeyedTable(spark, f"{tmp_path}/{parts}", KEYS, buckets=4)
        for i in range(parts):
            assert store.commit(operations.where(F.floor(F.col("op_no") * parts / 40) == i), audits.merged_audit, batch=i) == "applied"
        store.commit(operations.where(F.floor(F.col("op_no") * parts / 40) >= parts), audits.merged_audit, batch=parts)
        assert sorted(map(str, store.read().select(*audits.ROW).collect())) == whole


def test_replays_stale_epochs_and_lost_races_change_nothing(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), OPS)
    store = keyed.KeyedTable(spark, str(tmp_path), KEYS, kept=2)
    merge = audits.merged_audit
    assert store.read() is None and store.commit(frame(op(0, "open")), merge, batch=0, epoch=1) == "applied"
    assert store.commit(frame(op(0, "open", request="other")), merge, batch=0, epoch=1) == "replayed"
    assert store.commit(frame(op(1, "finish", "failure")), merge, batch=9, epoch=0) == "fenced"

    def slow(before, changes):  # another writer commits while this one merges
        rival = keyed.KeyedTable(spark, str(tmp_path), KEYS, kept=2)
        assert rival.commit(frame(op(1, "finish", "success")), merge, batch=1, epoch=2) == "applied"
        return merge(before, changes)

    assert store.commit(frame(op(1, "finish", "failure")), slow, batch=1, epoch=1) == "conflict"
    assert store.commit(frame(op(1, "finish", "failure")), merge, batch=1, epoch=1) == "fenced"
    assert [r.outcome for r in store.read().collect()] == ["success"] and store.read().count() == 1


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    store = keyed.KeyedTable(spark, str(tmp_path), KEYS, buckets=8, kept=2)
    first = spark.createDataFrame([op(0, "open", request=f"q{i}") for i in range(64)], OPS)
    store.commit(first, audits.merged_audit, batch=0)
    before = store.manifest().folders
    for i in range(1, 4):
        store.commit(spark.createDataFrame([op(i, "finish", "failure", request="q5")], OPS), audits.merged_audit, batch=i)
    after = store.manifest().folders
    assert sum(before[b] != after[b] for b in before) == 1 and store.versions() == [3, 4] and store.read().count() == 64
    assert store.manifest(1) is None and store.read(3).where("outcome = 'failure'").count() == 1
    held = {os.path.join(d, f) for d, _, files in os.walk(f"{tmp_path}/data") for f in files if f.endswith(".parquet")}
    named = {p for f in {*after.values(), *store.manifest(3).folders.values()} for p in held if p.startswith(f.removeprefix("file:") + "/")}
    assert held == named
    assert store.commit(first.limit(0), audits.merged_audit, batch=9) == "applied" and store.read().count() == 64


def test_a_stream_of_operations_with_a_batch_that_runs_again(spark, tmp_path):
    operations = logs.audit_operations(spark, SF).cache()
    for i in range(3):
        operations.where((F.col("op_no") >= 12 * i) & ((F.col("op_no") < 12 * i + 12) | F.lit(i == 2))).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store = keyed.KeyedTable(spark, f"{tmp_path}/table", KEYS)
    failed = []

    def fails_once(before, changes):
        if not failed:
            failed.append(1)
            raise ValueError("lost")
        return audits.merged_audit(before, changes)

    run = lambda: merge_stream(spark.readStream.schema(operations.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), store, fails_once, f"{tmp_path}/checkpoint", 0).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert sorted(map(str, store.read().select(*audits.ROW).collect())) == sorted(map(str, audits.merged_audit(None, operations).collect()))
    newer = store.commit(operations.limit(0), audits.merged_audit, batch=0, epoch=5)
    operations.limit(1).coalesce(1).write.parquet(f"{tmp_path}/in/late")
    assert newer == "applied"
    with pytest.raises(Exception, match="taken over"):
        run()


def test_group_store_puts_updates_and_filters(spark, tmp_path):
    schema = "session_id long, request_id string, op_no long, op string, created_at long, status string, diagnostic string"
    rows = [(1, "a", 0, "put", 5, "open", None), (1, "gone", 1, "update", None, "aborted", "x"), (1, "a", 2, "update", None, "success", None), (1, "b", 3, "put", 6, "open", None), (1, "b", 4, "put", 7, "aborted", "again"), (2, "c", 5, "put", None, "open", None)]
    whole = audits.group_store(None, spark.createDataFrame(rows, schema))
    expected = [(1, "a", 5, "success", None), (1, "b", 7, "aborted", "again"), (2, "c", None, "open", None)]
    assert sorted(map(tuple, whole.collect())) == expected
    store = keyed.KeyedTable(spark, str(tmp_path), KEYS)
    for i, row in enumerate(rows):
        store.commit(spark.createDataFrame([row], schema), audits.group_store, batch=i)
    assert sorted(map(tuple, store.read().select(whole.columns).collect())) == expected
    sessions = spark.createDataFrame([(1, 5), (2, None)], "session_id long, created_at long")
    assert [r.request_id for r in audits.records_for(whole, sessions).collect()] == ["a"]


FRAMES = "host long, generation long, arrival long, kind string, session_id long, revision long, stable string"


def fold(frames):
    """One frame at a time."""
    items, now = {}, {}
    for host, generation, _, kind, session, revision, stable in sorted(frames, key=lambda f: (f[0], f[2])):
        mine = items.setdefault(host, {})
        if now.get(host) != generation and kind == "baseline":
            now[host], items[host] = generation, {}
            items[host, "before"] = mine
            mine = items[host]
        if session is None:
            continue
        held = mine.get(session) if session in mine else (items[host, "before"].get(session) if kind == "baseline" else None)
        new = (revision, stable) if revision is not None else None
        mine[session] = new if new is None or held is None or new[0] > held[0] else held
    return sorted((h, s, now[h], *(v or (None, None))) for h, rows in items.items() if not isinstance(h, tuple) for s, v in rows.items())


def odd_frames():
    state = 12345
    rows, arrival = [], 0
    for generation in range(9):
        for i in range(30):
            state = (state * 1103515245 + 12345) % 2**31
            kind = "baseline" if i < 8 else "update"
            session = None if generation == 4 and kind == "baseline" else state // 7 % 12
            if kind == "baseline" and session is None and i:
                continue
            revision = None if session is None or state % 5 == 0 else state // 11 % 9
            rows.append((1, generation, arrival, kind, session, revision, None if revision is None else f"s{arrival}"))
            arrival += 1
    return rows + [(2, 0, 0, "baseline", None, None, None), (3, 0, 0, "update", 5, 1, "unopened")]


def test_baselines_replace_the_key_set(spark):
    rows = odd_frames()
    got = sorted(map(tuple, control.mirror(spark.createDataFrame(rows, FRAMES)).collect()), key=str)
    assert got == sorted((r for r in fold([f for f in rows if f[0] != 3])), key=str) and len(got) > 3


@pytest.mark.parametrize("cut", [1, 17, 100])
def test_a_mirror_kept_by_a_stream_with_replays_and_a_late_baseline(spark, tmp_path, cut):
    rows = odd_frames()[:-1]
    parts = [rows[:cut], rows[max(0, cut - 20) : cut + 40], rows[cut + 40 :]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store = keyed.KeyedTable(spark, f"{tmp_path}/table", ("host", "session_id"), buckets=4)
    for i in range(len(parts)):
        store.commit(spark.read.parquet(f"{tmp_path}/in/{i}"), control.mirror_rows, batch=i)
    whole = sorted(map(str, control.mirror(spark.createDataFrame(rows, FRAMES)).collect()))
    assert sorted(map(str, control.shown(store.read()).collect())) == whole
    if cut == 17:
        streamed = keyed.KeyedTable(spark, f"{tmp_path}/streamed", ("host", "session_id"), buckets=4)
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        control.mirror_stream(stream, streamed, f"{tmp_path}/checkpoint").awaitTermination()
        assert sorted(map(str, control.shown(streamed.read()).collect())) == whole
