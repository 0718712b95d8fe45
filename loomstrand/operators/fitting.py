"""The longest prefix of a list of items whose written form fits a budget, and what is written round it.

A written list is what stands before it, its items with a separator between every two, and what stands behind. Its size grows by
each item's own written size, so running sums find the longest prefix that fits: one window over (group, place), no text is put
together to be measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.functions.blocks import BLOCK, BLOCK_TOKENS, ROLE_TOKENS
from loomstrand.functions.rows import once
from loomstrand.functions.text import OVERHEAD_TOKENS, bounded, is_blank, trimmed, utf16_length

# What frames a checkpoint.
PREAMBLE = "This is an automatically generated checkpoint condensing an earlier span of the conversation to free up context. Treat the captured context as established background and build on it without restating it. Continue the task directly from the messages that follow, without acknowledging this checkpoint."
OPEN_TAG, CLOSE_TAG = "<compacted-summary>", "</compacted-summary>"


def written_bytes(value: Column) -> Column:
    """UTF-8 bytes of a value as JSON text, quotes and escapes included."""
    return (F.octet_length(F.to_json(F.array(value))) - 2).cast("long")


def fitting_prefix(items: DataFrame, group: str | list[str], place: str, size: Column, most: Column | int, budget: Column | int, separator: int = 1) -> DataFrame:
    """`items` with `fits`, `taken_bytes` and `over`: whether an item is in the longest prefix of its group that has at most `most` items and
    whose sizes and separators sum up to at most `budget`, the sum up to it, and whether the first item alone is too large.

    Sizes can't be negative, so that once a prefix is too large all longer ones are; a null size counts as nothing.
    """
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    so_far = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(Window.partitionBy(group).orderBy(place))
    rows = items.withColumns({"_number": number, "_sum": F.sum(F.coalesce(size, F.lit(0))).over(so_far)})
    total = F.col("_sum") + separator * (F.col("_number") - 1)
    fits = (F.col("_number") <= lit(most)) & (total <= lit(budget))
    first = F.first("_sum").over(Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"fits": F.coalesce(fits, F.lit(False)), "taken_bytes": total.cast("long"), "over": F.coalesce(first > lit(budget), F.lit(False))}).drop("_number", "_sum")


def event_windows(events: DataFrame, bases: DataFrame, most_events: int, most_bytes: int) -> DataFrame:
    """(session_id, outcome, n, source_cursor, bytes) of each session's next fold: the longest run of events whose frame fits.

    `events`: (session_id, seq, type, fields, truncation): projected events, `fields` being JSON text and `truncation` a list of structs;
    `bases`: (session_id, base): JSON text of the state that the fold starts from, null for none, one row for each session. A frame is
    {"base":...,"events":[{"seq":..,"type":..,"fields":..},...],"truncation":[...]}. `empty` without events, `infeasible` where the base
    alone or the first event with it is too large (`bytes` says how large).
    """
    frame = F.octet_length(F.concat(F.lit('{"base":'), F.coalesce("base", F.lit("null")), F.lit(',"events":[],"truncation":[]}'))).cast("long")
    head = F.octet_length(F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"type":'), F.to_json(F.array("type")), F.lit(',"fields":}'))) - 2
    cuts = F.size("truncation")
    # Two lists grow at once: of the second, commas are counted with the items that need them.
    cut_bytes = F.when(cuts > 0, F.octet_length(F.to_json("truncation")) - 2).otherwise(0)
    sized = events.select("session_id", "seq", (head + F.octet_length("fields") + cut_bytes).cast("long").alias("size"), cuts.alias("cuts")).join(bases.select("session_id", frame.alias("frame")), "session_id")
    before = F.coalesce(F.sum("cuts").over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("size", F.col("size") + F.when((F.col("cuts") > 0) & (before > 0), 1).otherwise(0))
    fitted = fitting_prefix(sized, "session_id", "seq", F.col("size"), most_events, F.lit(most_bytes) - F.col("frame"))
    taken = F.col("fits")
    sums = fitted.groupBy("session_id").agg(
        F.max("frame").alias("frame"), F.count_if(taken).alias("n"), F.max(F.when(taken, F.col("seq"))).alias("source_cursor"), F.max(F.when(taken, F.col("taken_bytes"))).alias("taken"), F.min("taken_bytes").alias("least")
    )
    rows = bases.select("session_id", frame.alias("alone")).join(sums.drop("frame"), "session_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    outcome = F.when(F.col("alone") > most_bytes, "infeasible").when(F.col("least").isNull(), "empty").when(n == 0, "infeasible").otherwise("window")
    size = F.when(F.col("alone") > most_bytes, F.col("alone")).when(n > 0, F.col("alone") + F.col("taken")).otherwise(F.col("alone") + F.coalesce("least", F.lit(0)))
    return rows.select("session_id", outcome.alias("outcome"), n.alias("n"), "source_cursor", size.cast("long").alias("bytes"))


def framed(summary: Column) -> Column:
    """The blocks of a summary in the frame of a checkpoint: one text block before them, one behind."""
    block = lambda path, text: F.array(F.struct(F.lit(path).alias("path"), F.lit("text").alias("kind"), F.lit(text).alias("text"), F.lit(None).cast("string").alias("rich")).cast(BLOCK))
    return F.concat(block("head", f"{PREAMBLE}\n\n{OPEN_TAG}"), summary, block("tail", CLOSE_TAG))


def least_checkpoint_tokens() -> int:
    """Tokens of a checkpoint without a summary: a span that costs no more can't be made smaller."""
    return ROLE_TOKENS + sum(BLOCK_TOKENS + -(-len(text) // 4) for text in (f"{PREAMBLE}\n\n{OPEN_TAG}", CLOSE_TAG))


def input_item(type_: Column, seq: Column, call_id: Column, content: Column, calls: Column) -> Column:
    """What a summary of a group reads of one event, as JSON text: a result's first block, or a message's calls line by line."""
    lines = F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit(" "), c["arguments"])), "\n")
    result = F.to_json(F.struct(seq.alias("sourceSeq"), F.lit("tool-result").alias("role"), call_id.alias("callId"), F.coalesce(content, F.lit("")).alias("content")))
    called = F.to_json(F.struct(seq.alias("sourceSeq"), F.lit("tool-call").alias("role"), F.coalesce(lines, F.lit("")).alias("content")))
    return F.when(type_ == "tool/result", result).when(type_ == "assistant/message", called)


def group_inputs(items: DataFrame, cap: int, reserve: int, instruction: str, version: int = 1) -> DataFrame:
    """(session_id, group_id, items, fitting, tokens, fits): how much of each group's input one auxiliary request can hold.

    `items`: (session_id, group_id, pos, item), `item` from `input_item`; null ones are left out. `tokens` is the price of instruction, input
    and reserve for the whole group, `fits` whether that is within the cap, and `fitting` the items of the longest prefix that would be.
    """
    frame = len(f'{instruction}\n\nINPUT:\n{{"version":{version},"items":[]}}')
    reserve = max(0, reserve)
    price = lambda n: OVERHEAD_TOKENS + F.ceil((n + frame) / 4) + reserve
    room = (cap - reserve - OVERHEAD_TOKENS) * 4 - frame
    # An item is long and is written once, where it is measured; windows only see its size. Groups are parts of sessions and move no further.
    rows = once(items, _units=utf16_length("item").cast("long")).where("_units is not null").drop("item")
    fitted = fitting_prefix(rows, ["session_id", "group_id"], "pos", F.col("_units"), 2**31 - 1, room)
    sums = fitted.groupBy("session_id", "group_id").agg(F.count("*").alias("items"), F.count_if("fits").alias("fitting"), F.max("taken_bytes").alias("_all"))
    return sums.select("session_id", "group_id", "items", "fitting", price(F.col("_all")).cast("long").alias("tokens"), (price(F.col("_all")) <= cap).alias("fits"))


def todo_reference(todo: Column, most_bytes: int) -> Column:
    """One bounded line for a current TODO list, or null: cleared and empty lists, and lists from nowhere, have none."""
    items = F.filter(todo["items"], lambda i: ~is_blank(i["content"]))
    line = bounded(F.array_join(F.transform(items, lambda i: F.concat(trimmed(i["content"]), F.lit(" ["), i["status"], F.lit("]"))), "; "), most_bytes)
    return F.when((todo["status"] == "current") & todo["source_seq"].isNotNull() & (F.size(items) > 0), F.struct(todo["source_seq"].alias("seq"), line.alias("content")))
