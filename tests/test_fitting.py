"""Prefixes that fit, against writing them out."""

import json
import random

from pyspark.sql import functions as F

from loomstrand.functions import blocks
from loomstrand.operators import fitting

CUT = "array<struct<path: string, limit_bytes: bigint, kept_bytes: bigint>>"
compact = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def fold(events, base, most, budget):
    """One event at a time, the whole frame written out each time."""
    frame = lambda held, cuts: len(('{"base":' + (base or "null") + ',"events":[' + ",".join(held) + '],"truncation":' + compact(cuts) + "}").encode())
    size = frame([], [])
    if size > budget:
        return ("infeasible", 0, None, size)
    held, cuts, cursor = [], [], None
    for seq, kind, fields, cut in sorted(events):
        if len(held) >= most:
            break
        more = [*held, f'{{"seq":{seq},"type":{compact(kind)},"fields":{fields}}}']
        n = frame(more, cuts + cut)
        if n > budget:
            if not held:
                return ("infeasible", 0, None, n)
            break
        held, cuts, cursor, size = more, cuts + cut, seq, n
    return ("window", len(held), cursor, size) if held else ("empty", 0, None, size)


def test_windows_against_writing_them_out(spark):
    rng = random.Random(2)
    events, bases, expected = [], [], {}
    for session in range(120):
        own = []
        for seq in range(rng.randint(0, 9)):
            cuts = [{"path": rng.choice(["a", 'q"é']), "limit_bytes": 9, "kept_bytes": rng.randint(1, 999)} for _ in range(rng.choice([0, 0, 1, 3]))]
            own.append((seq * 3, rng.choice(["user/message", 'odd"type']), compact({"t": "é\n" * rng.randint(0, 40)}), cuts))
        base = rng.choice([None, compact({"b": "x" * rng.randint(0, 420)})])
        bases.append((session, base))
        events += [(session, seq, kind, fields, [tuple(c.values()) for c in cuts]) for seq, kind, fields, cuts in own]
        expected[session] = fold(own, base, 5, 450)
    frame = spark.createDataFrame(events, f"session_id long, seq long, type string, fields string, truncation {CUT}").repartition(5)
    found = fitting.event_windows(frame, spark.createDataFrame(bases, "session_id long, base string"), 5, 450)
    assert {r.session_id: tuple(r)[1:] for r in found.collect()} == expected
    assert {v[0] for v in expected.values()} == {"window", "empty", "infeasible"}


def test_prefixes_of_ties_and_nulls(spark):
    rows = [("g", 0, 3), ("g", 1, None), ("g", 2, 5), ("g", 3, 0), ("h", 0, 99), ("h", 1, 1), (None, 0, 2)]
    frame = spark.createDataFrame(rows, "g string, place long, size long")
    got = {(r.g, r.place): (r.fits, r.taken_bytes, r.over) for r in fitting.fitting_prefix(frame, "g", "place", F.col("size"), 3, 10).collect()}
    assert got[("g", 2)] == (True, 10, False) and got[("g", 3)][0] is False and got[("h", 0)] == (False, 99, True) and not got[("h", 1)][0] and got[(None, 0)][0]


def test_frames_and_references(spark):
    empty = F.array().cast(f"array<{blocks.BLOCK}>")
    text = spark.range(1).select(fitting.framed(empty).alias("t"), blocks.token_sum(fitting.framed(empty)).alias("price"), fitting.written_bytes(F.lit('a"é\n')).alias("n")).first()
    assert text.price == fitting.least_checkpoint_tokens() and text.n == len(compact('a"é\n').encode())
    assert [b.path for b in text.t] == ["head", "tail"] and text.t[0].text.endswith("\n\n" + fitting.OPEN_TAG)
    schema = "todo struct<status: string, source_seq: bigint, items: array<struct<content: string, status: string>>>"
    rows = [(("current", 4, [(" a ", "done"), (" ", "x"), ("b", "pending")]),), (("cleared", 4, [("a", "x")]),), (("current", None, [("a", "x")]),), (("current", 4, [("  ", "x")]),), (None,), (("current", 4, [("é" * 50, "x")]),)]
    found = [r.r for r in spark.createDataFrame(rows, schema).select(fitting.todo_reference(F.col("todo"), 40).alias("r")).collect()]
    assert found[0].content == "a [done]; b [pending]" and found[1:5] == [None] * 4 and len(found[5].content.encode()) <= 40
