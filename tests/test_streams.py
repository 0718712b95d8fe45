"""The same operators on streams."""

import json

from pyspark.sql import functions as F

from loomstrand.operators import replay
from loomstrand.sources import keyed, logs
from loomstrand.streaming import control, folds


def drained(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_counters_of_a_stream(spark, tmp_path):
    rows = [(1, 0, "request/header"), (1, 1, "compaction/prune"), (1, 2, "compaction/end"), (2, 0, "user/message")]
    logs.append_log(spark.createDataFrame(rows, "session_id long, seq long, type string").repartition(1), f"{tmp_path}/log")
    stream = spark.readStream.schema("session_id long, seq long, type string").parquet(f"{tmp_path}/log")
    assert sorted(map(tuple, drained(replay.evidence_counters(stream), "counters", "complete"))) == [(1, 1, 1, 1), (2, 0, 0, 0)]


def test_folds_by_count(spark, tmp_path):
    schema = "session_id long, seq long, type string"
    first = [(1, i, "user/message") for i in range(7)] + [(2, 0, "todo/write")]
    again = [(1, i, "user/message") for i in range(5, 12)] + [(2, 0, "todo/write"), (2, 1, "user/message")]
    for i, rows in enumerate((first, again)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = sorted(map(tuple, drained(folds.counted_folds(stream.select("session_id", "seq", "type"), least=5, most=5), "folds", "append")))
    assert got == [(1, "threshold", 5, 0, 4), (1, "threshold", 5, 5, 9), (2, "urgent", 1, 0, 0)]


def test_control_upserts(spark, tmp_path):
    frames = [[(1, 0, "baseline", 1, "a"), (2, 1, "update", 5, "b")], [(1, 2, "update", 3, "c"), (2, 3, "update", 4, "late")], [(1, 4, "update", 3, None)]]
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, "session_id long, arrival long, kind string, revision long, stable string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("session_id long, arrival long, kind string, revision long, stable string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store = keyed.KeyedTable(spark, f"{tmp_path}/state", ("session_id",), kept=1)
    control.upsert_stream(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    newest = store.read().select("session_id", "revision", "stable")
    assert store.versions() == [3]
    assert sorted(map(tuple, newest.collect())) == [(1, 3, None), (2, 5, "b")]
    whole = spark.createDataFrame([r for rows in frames for r in rows], "session_id long, arrival long, kind string, revision long, stable string")
    assert sorted(map(tuple, control.latest(whole).collect())) == [(1, 3, None), (2, 5, "b")]


def test_frames_and_logs_from_json(spark, tmp_path):
    raw = spark.createDataFrame([('{"session_id":1,"arrival":1,"kind":"update","revision":2,"stable":"x"}',), ("{bad",), ('{"session_id":1,"kind":"other","revision":2}',)], "value string")
    assert [tuple(r) for r in control.decoded(raw).collect()] == [(1, 1, "update", 2, "x")]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([json.dumps({"session_id": 1, "seq": 0, "type": "user/message", "data": {"a": [1, None]}}), "{bad"]))
    rows = logs.read_jsonl(spark, str(path)).orderBy(F.col("seq").asc_nulls_last()).collect()
    assert rows[0].type == "user/message" and json.loads(rows[0].data) == {"a": [1, None]} and rows[1].seq is None
