"""Block contents against a walk over nested lists."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomstrand.functions import blocks
from loomstrand.functions.text import PRUNE_MARKER
from loomstrand.operators import reductions


def nested(rng, depth=0):
    made = []
    for _ in range(rng.randint(0, 5)):
        kind = rng.choice(["text", "text", "image", "tool-result"] if depth < 2 else ["text", "image"])
        if kind == "text":
            made.append({"type": "text", "text": "".join(rng.choices("ab é陳👍", k=rng.randint(0, 30)))})
        elif kind == "image":
            made.append({"type": "image", "data": rng.randint(0, 9)})
        else:
            made.append({"type": "tool-result", "toolCallId": "c", "content": nested(rng, depth + 1)})
    return made


def flat(items, prefix=""):
    for i, b in enumerate(items):
        yield (f"{prefix}{i}", b["type"], b.get("text"))
        if b["type"] == "tool-result":
            yield from flat(b["content"], f"{prefix}{i}.")


def pruned(items, limit, head, tail, inside=True):
    """(kind, text) of what stays, in order."""
    rows = list(flat(items))
    counted = [b[1] == "text" and (inside or "." not in b[0]) for b in rows]
    total = sum(len(b[2]) for b, c in zip(rows, counted, strict=True) if c)
    if total <= limit:
        return None
    at, marked, out = 0, False, []
    for (path, kind, text), c in zip(rows, counted, strict=True):
        if not c:
            out.append((path, kind, text))
            continue
        kept = "".join(ch for i, ch in enumerate(text, at) if i < head)
        rest = "".join(ch for i, ch in enumerate(text, at) if i >= total - tail)
        inner = not marked and at < total - tail and at + len(text) > head
        marked |= inner
        at += len(text)
        if kept or rest or inner:
            out.append((path, kind, kept + (PRUNE_MARKER if inner else "") + rest))
    return out


@pytest.mark.parametrize("inside", [True, False])
def test_clipping_against_a_walk(spark, inside):
    rng = random.Random(7)
    contents = [nested(rng) for _ in range(900)]
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(contents)], "i long, content string").withColumn("blocks", blocks.blocks_of(F.col("content")))
    cut = blocks.clipped(F.col("blocks"), limit=60, threshold=60, head=9, tail=7, nested=inside)
    rows = frame.select("i", "blocks", cut.alias("cut"), blocks.measured(F.col("blocks"), inside).alias("n"), blocks.measured(cut, inside).alias("left")).collect()
    cuts = 0
    for r in rows:
        expected = pruned(contents[r.i], 60, 9, 7, inside)
        assert [(b.path, b.kind, b.text) for b in r.blocks] == list(flat(contents[r.i]))
        assert (None if r.cut is None else [(b.path, b.kind, b.text) for b in r.cut]) == expected
        if expected is not None:
            cuts += 1
            assert r.left == 9 + 7 + len(PRUNE_MARKER) < r.n
    assert cuts > 20


def test_odd_contents(spark):
    raw = [None, "", "{}", "[]", '["x", 1, null, {"type":"text"}, {"text":"no type"}]', '[{"type":"tool-result"}]', '[{"type":"text","text":"' + "é" * 300_000 + '"}]']
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(raw)], "i long, content string").withColumn("blocks", blocks.blocks_of(F.col("content")))
    rows = frame.orderBy("i").select(blocks.measured(F.col("blocks")).alias("n"), F.size(F.coalesce("blocks", F.array().cast(f"array<{blocks.BLOCK}>"))).alias("k"), F.size(blocks.clipped(F.col("blocks"))).alias("cut"), blocks.replaced(F.col("blocks"), F.lit("s")).alias("new")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 0, 0, 0, 300_000] and [r.k for r in rows][4:] == [2, 1, 1] and rows[6].cut == 1
    assert all(r.new is None for r in rows)
    with pytest.raises(ValueError):
        blocks.clipped(F.col("blocks"), limit=10, threshold=20)


def test_a_summary_keeps_all_but_the_texts_of_results(spark):
    content = [{"type": "text", "text": "m"}, {"type": "tool-result", "content": [{"type": "image"}, {"type": "text", "text": "x" * 99}, {"type": "tool-result", "content": [{"type": "text", "text": "deep"}]}]}, {"type": "image"}, {"type": "tool-result", "content": [{"type": "text", "text": "y"}]}]
    results = spark.createDataFrame([(1, 0, 5, json.dumps(content)), (1, 1, 6, json.dumps(content)), (1, 2, 7, json.dumps(content))], "session_id long, pos long, seq long, content string").withColumn("blocks", blocks.blocks_of(F.col("content")))
    summaries = spark.createDataFrame([(1, 5, "short"), (1, 6, "long " * 99), (1, 7, None)], "session_id long, seq long, text string")
    ends = spark.createDataFrame([(1, 100)], "session_id long, next_seq long")
    rows = reductions.block_summaries(results, summaries, ends).orderBy("seq").collect()
    assert [(r.seq, r.type, r.covers) for r in rows] == [(100, "compaction/prune", []), (101, "tool/result", [5])]
    assert [(b.path, b.text) for b in rows[1].blocks] == [("0", "m"), ("1", None), ("1.summary", "short"), ("1.0", None), ("1.2", None), ("1.2.0", "deep"), ("2", None), ("3", None)]


def test_spans_that_changed_close_with_an_error(spark):
    surface = spark.createDataFrame([(1, i, s) for i, s in enumerate([4, 9, 2, 7])] + [(2, 0, 1)], "session_id long, pos long, seq long")
    spans = spark.createDataFrame([(1, [9, 2]), (2, [1, 3]), (3, [5]), (1, [9, 7]), (1, []), (1, [4, 9, 2, 7])], "session_id long, covers array<long>")
    got = [(r.session_id, r.stable) for r in reductions.span_stability(spans, surface).collect()]
    assert sorted(got) == [(1, False), (1, False), (1, True), (1, True), (2, False), (3, False)]
    assert sorted(r.stable for r in reductions.span_stability(spans, surface, whole=True).collect()) == [False] * 5 + [True]
    ends = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "session_id long, next_seq long")
    priced = spark.createDataFrame([(1, [9, 2], 50, 10, True), (2, [1], 50, 10, False), (3, [5], 50, 50, True)], "session_id long, covers array<long>, tokens long, price long, stable boolean")
    rows = reductions.region_rows(priced, ends).orderBy("seq").collect()
    assert [(r.seq, r.error) for r in rows] == [(10, None), (11, None), (12, None), (13, None), (20, None), (21, "span-changed"), (30, None), (31, "summary-not-smaller")]
