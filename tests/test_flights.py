"""Single flights: orders of signals, restarts and failures."""

import time

from loomstrand.streaming.flights import SIGNAL, Flight, Limits, single_flights

SMALL = Limits(least=3, most=5)


def run(*signals, limits=SMALL):
    """(flight, trigger, n, first, last) of what is launched; numbers are events, '!' marks urgent ones."""
    own, out = Flight(limits), []
    for s in signals:
        if isinstance(s, int):
            made = own.event(s, False)
        elif s.startswith("!"):
            made = own.event(int(s[1:]), True)
        elif s.startswith(("ok", "bad")):
            word, flight, cursor = (s.split() + ["-1", "-1"])[:3]
            made = own.settled(int(flight), word == "ok", int(cursor))
        else:
            made = getattr(own, s)()
        own = Flight(limits, own.state())  # as after a restart
        if made:
            out.append(made)
    return out


def test_a_threshold_and_one_trailing_fold():
    assert run(0, 1) == []
    assert run(0, 1, 2) == [(1, "threshold", 3, 0, 2)]
    assert run(0, 1, 2, 3, 4, "ok 1 2") == [(1, "threshold", 3, 0, 2), (2, "trailing", 2, 3, 4)]
    assert run(0, 1, 2, "ok 1 2", 3, 4) == [(1, "threshold", 3, 0, 2)]
    # A trailing fold is not followed by another, but for a threshold.
    assert run(0, 1, 2, 3, "ok 1 2", 4, 5, "ok 2 3")[2:] == []
    assert run(0, 1, 2, 3, "ok 1 2", 4, 5, 6, "ok 2 3")[2:] == [(3, "threshold", 3, 4, 6)]


def test_failures_schedule_nothing_and_keep_what_waits():
    assert run(0, 1, 2, 3, 4, "bad 1") == [(1, "threshold", 3, 0, 2)]
    assert run(0, 1, 2, 3, "bad 1", 4) == [(1, "threshold", 3, 0, 2), (2, "threshold", 5, 0, 4)]
    assert run("!0", "!1", "bad 1") == [(1, "urgent", 1, 0, 0)]


def test_late_and_repeated_reports_and_events():
    assert run(0, 1, 2, "ok 1 2", "ok 1 2", 3, 4, 5, "ok 1 5", "bad 1", 6) == [(1, "threshold", 3, 0, 2), (2, "threshold", 3, 3, 5)]
    assert run(0, 1, 1, 0, 1) == [] and run("!0", "ok 1 0", "!0") == [(1, "urgent", 1, 0, 0)]


def test_urgent_facts():
    assert run(0, "!1") == [(1, "urgent", 2, 0, 1)]
    assert run(0, 1, 2, "!3", "ok 1 2") == [(1, "threshold", 3, 0, 2), (2, "urgent", 1, 3, 3)]
    # A fact that the fold took in already is not outstanding.
    assert run("!0", "!1", "ok 1 1") == [(1, "urgent", 1, 0, 0)]
    assert run("!0", "!1", "ok 1 0", "!2", "ok 2 1", "ok 3 2") == [(1, "urgent", 1, 0, 0), (2, "urgent", 1, 1, 1), (3, "urgent", 1, 2, 2)]


def test_start_up_and_by_hand():
    assert run(0, 1, "hydrated", 2) == [(1, "threshold", 3, 0, 2)]
    assert run("manual", 0, "manual", 1, "ok 1 0") == [(1, "manual", 1, 0, 0)]
    assert run(0, "manual", 1, "manual", "ok 1 0") == [(1, "manual", 1, 0, 0), (2, "trailing", 1, 1, 1)]
    own = Flight(SMALL, (2, 0, None, False, False, False, -1, -1, [0, 1, 2]))
    assert own.hydrated() == (1, "startup", 3, 0, 2) and own.hydrated() is None


def test_most_of_one_fold():
    assert run("!0", 1, 2, 3, 4, 5, 6, 7, "ok 1 0", "ok 2 5") == [(1, "urgent", 1, 0, 0), (2, "threshold", 5, 1, 5), (3, "trailing", 2, 6, 7)]


def test_a_stream_with_a_restart_and_a_silent_fold(spark, tmp_path):
    parts = [
        [(1, i, "event", i, False, None, None) for i in range(4)] + [(2, 0, "event", 0, True, None, None)],
        [(1, 2, "event", 2, False, None, None), (1, 4, "settled", 2, None, 1, True), (2, 1, "event", 1, False, None, None)],
    ]
    launches = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    limits = Limits(least=3, most=5, patience=20_000)

    def drain(seconds=8):
        # A stream with timers has no last batch, and nothing says that it has read all.
        stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = single_flights(stream, limits).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out"))
        query = query.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds").start()
        try:
            query.awaitTermination(seconds)
        finally:
            query.stop()

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SIGNAL).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        drain()
    assert launches() == [(1, 1, "threshold", 3, 0, 2), (1, 2, "trailing", 1, 3, 3), (2, 1, "urgent", 1, 0, 0)]
    # The folds that run report too late: once that is found out nothing is launched for it, and the next fact is.
    time.sleep(limits.patience / 1000)
    drain()
    late = [(2, 2, "event", 2, True, None, None), (2, 3, "settled", 0, None, 1, True)]
    spark.createDataFrame(late, SIGNAL).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    drain()
    assert launches()[3:] == [(2, 2, "urgent", 3, 0, 2)]
