"""Eligible events and what is kept of them, latest-wins views, and folds above a cursor."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.functions import text
from loomstrand.functions.rows import once

# Event types that may enter a fold.
ELIGIBLE = (
    "user/message", "assistant/message", "tool/call", "tool/result", "turn/end", "goal/change", "request/header", "agent-preset/selected",
    "compaction/start", "compaction/end", "todo/write", "plan/mode", "command/run",
)
COMMANDS = ("goal", "plan", "compact")
SELECTIONS = ("initial", "resume", "change")
CUT = "array<struct<path: string, limit_bytes: bigint, kept_bytes: bigint>>"


class Limits(NamedTuple):
    """Bytes that each kind of field keeps at most."""

    # The default limits.
    user_message: int = 4_000
    assistant_message: int = 2_000
    tool_name: int = 200
    tool_arguments: int = 2_000
    tool_result_text: int = 4_000
    tool_result_meta: int = 2_000
    json_leaf: int = 400
    error: int = 400
    command: int = 400
    state: int = 2_000


ITEM = "array<struct<content: string, status: string>>"


def _at(path: str) -> Column:
    return F.get_json_object("data", f"$.{path}")


def _filled(c: Column) -> Column:
    return F.when(~text.is_blank(c), c)


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _said(value: Column, path: str) -> Column:
    """What a JSON value says at a path, if that is a string."""
    return F.when(F.schema_of_variant(_part(value, path)) == "STRING", F.try_variant_get(value, f"$.{path}", "string"))


def _is_record(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_part(value, path)).startswith("OBJECT"), F.lit(False))


def _is_true(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{path}", "boolean") & (F.schema_of_variant(_part(value, path)) == "BOOLEAN"), F.lit(False))


def _whole(value: Column, path: str) -> Column:
    """A number at a path, if it is whole and within 53 bits."""
    number = F.try_variant_get(value, f"$.{path}", "double")
    good = F.regexp_like(F.schema_of_variant(_part(value, path)), F.lit("BIGINT|DECIMAL|DOUBLE|FLOAT")) & (number == F.floor(number)) & (F.abs(number) < 2**53)
    return F.when(good, number.cast("long"))


def _texts(value: Column, path: str) -> Column:
    """Non-blank text blocks of a list of blocks, by lines; whatever else the list holds is passed over."""
    blocks = F.try_variant_get(value, f"$.{path}", "array<variant>")
    said = F.transform(blocks, lambda b: F.when(F.try_variant_get(b, "$.type", "string") == "text", _filled(_said(b, "text"))))
    return F.array_join(said, "\n")


def _of(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def _by_type(cases: dict[str, Column]) -> Column:
    made = F.lit(None)
    for kind, value in reversed(cases.items()):
        made = F.when(_of(kind), value).otherwise(made)
    return made


BLOCK, CONFIG, GOAL = "message.content[0]", "header.config", "goal"


def _slots(log: DataFrame, leaf_bytes: int) -> DataFrame:
    """Rows of eligible types whose payload is a JSON object, parsed once: `_v`, up to four texts `_a` to `_d` that may be bounded, the
    leaves of tool payloads, and `_kept`, whether the event means something."""
    rows = log.where(_of(*ELIGIBLE) & F.ltrim("data").startswith("{"))
    rows = once(rows, _v=F.try_parse_json("data")).where("_v is not null")
    v, tool = F.col("_v"), F.when(_of("tool/call", "tool/result"), F.col("type"))
    rows = rows.withColumn("_leaves", rendered_leaves(leaf_bytes)(tool, F.when(tool.isNotNull(), F.col("data"))))
    result = F.when(F.try_variant_get(v, f"$.{BLOCK}.type", "string") == "tool-result", _texts(v, f"{BLOCK}.content"))
    string = lambda path: F.coalesce(_said(v, path), F.lit(""))
    rows = once(
        rows,
        _a=_by_type({
            "user/message": _texts(v, "content"), "assistant/message": _texts(v, "message.content"), "tool/call": string("name"), "tool/result": _filled(result), "goal/change": string(f"{GOAL}.objective"),
            "request/header": string(f"{CONFIG}.provider"), "agent-preset/selected": string("agentPreset"), "compaction/start": string("compactionId"), "compaction/end": _filled(_said(v, "error")), "command/run": _filled(_said(v, "args")),
        }),
        _b=_by_type({"tool/call": F.col("_leaves.rendered"), "tool/result": _filled(_said(v, "error.name")), "request/header": string(f"{CONFIG}.model"), "compaction/end": string("compactionId")}),
        _c=_by_type({"tool/result": _filled(_said(v, "error.code")), "request/header": F.nullif(string(f"{CONFIG}.reasoningEffort"), F.lit(""))}),
        _d=F.when(_of("tool/result"), _filled(F.col("_leaves.rendered"))),
        _source=F.when(_of("user/message", "command/run"), F.try_variant_get(v, "$.source.kind", "string")),
        _todos=F.when(_of("todo/write"), F.try_variant_get(v, "$.todos", "array<variant>")),
        _word=_by_type({"goal/change": _said(v, "operation"), "request/header": _said(v, "reason"), "command/run": _said(v, "name")}),
    )
    kept = _by_type({
        "user/message": F.col("_source").isin("user", "goal") & (F.col("_a") != ""),
        "assistant/message": ~_is_true(v, "interrupted") & (F.col("_a") != ""),
        "tool/result": F.coalesce("_a", "_b", "_c", "_d").isNotNull(),
        "goal/change": (F.col("_word") == "clear") | _is_record(v, GOAL),
        "todo/write": F.col("_todos").isNotNull(),
        "request/header": F.col("_word").isin(*SELECTIONS) & (F.col("_a") != "") & (F.col("_b") != ""),
        "agent-preset/selected": F.col("_a") != "",
        "command/run": F.col("_word").isin(*COMMANDS),
        **{kind: F.lit(True) for kind in ("tool/call", "turn/end", "plan/mode", "compaction/start", "compaction/end")},
    })
    return once(rows, _kept=F.coalesce(kept, F.lit(False)))


def kept_events(log: DataFrame) -> DataFrame:
    """(session_id, seq, type) of the events of which a projection keeps something; none of it is cut or written out."""
    return _slots(log, text.ELLIPSIS_BYTES).where("_kept").select("session_id", "seq", "type")


def projected(log: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(session_id, seq, type, kind, text, fields, truncation) of the events that mean something.

    `fields` is a JSON object of what is kept, without what is absent; `text` is its text, if any; `truncation` lists the fields
    that were cut, in order, with their limits and the bytes kept. Payloads are parsed once, by one strict parser: what is null, no
    JSON object, nested beyond a thousand levels or repeats a key gives no row. What is no string where a string belongs counts
    as absent, and what is no block or item in a list is passed over (blocks) or stands for an empty one (items).
    """
    # What cut fields are called, by slot and type, and how many bytes they keep.
    names = {
        "_a": {
            "user/message": ("user/message.text", limits.user_message), "assistant/message": ("assistant/message.text", limits.assistant_message), "tool/call": ("tool/call.name", limits.tool_name),
            "tool/result": ("tool/result.text", limits.tool_result_text), "goal/change": ("goal/change.objective", limits.state), "request/header": ("request/header.provider", limits.tool_name),
            "agent-preset/selected": ("agent-preset/selected.preset", limits.tool_name), "compaction/start": ("compaction/start.compactionId", limits.error), "compaction/end": ("compaction/end.error", limits.error),
            "command/run": ("command/run.args", limits.command),
        },
        "_b": {
            "tool/call": ("tool/call.arguments", limits.tool_arguments), "tool/result": ("tool/result.error.name", limits.error), "request/header": ("request/header.model", limits.tool_name),
            "compaction/end": ("compaction/end.compactionId", limits.error),
        },
        "_c": {"tool/result": ("tool/result.error.code", limits.error), "request/header": ("request/header.reasoningEffort", limits.tool_name)},
        "_d": {"tool/result": ("tool/result.meta", limits.tool_result_meta)},
    }
    rows = _slots(log, limits.json_leaf).where("_kept")
    rows = once(rows, **{f"{slot}_limit": _by_type({k: F.lit(n) for k, (_, n) in own.items()}) for slot, own in names.items()})
    rows = once(rows, **{slot[1:]: text.bounded(slot, F.col(f"{slot}_limit")) for slot in names})
    v, a, b, c, d = F.col("_v"), *[F.col(slot[1:]) for slot in names]
    items = F.transform("_todos", lambda i: F.struct(F.coalesce(_said(i, "content"), F.lit("")).alias("content"), F.coalesce(_said(i, "status"), F.lit("")).alias("status")))
    cut_items = F.transform(items, lambda i: F.struct(text.bounded(i["content"], limits.state).alias("content"), i["status"].alias("status"), (F.octet_length(i["content"]) > limits.state).alias("cut")))
    rows = once(rows, _items=cut_items)

    def record(path: Column, limit: Column, kept: Column) -> Column:
        return F.struct(path.alias("path"), limit.cast("long").alias("limit_bytes"), F.octet_length(kept).cast("long").alias("kept_bytes"))

    def cut(slot: str) -> Column:
        path = _by_type({k: F.lit(p) for k, (p, _) in names[slot].items()})
        return F.when(F.octet_length(slot) > F.col(f"{slot}_limit"), record(path, F.col(f"{slot}_limit"), F.col(slot[1:])))

    def json_of(kind: str, **values: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("kind"), *[x.alias(k) for k, x in values.items()]))

    string = lambda path: F.coalesce(_said(v, path), F.lit(""))
    ended, inner = F.try_variant_get(v, "$.reason.kind", "string"), F.try_variant_get(v, "$.reason.reason.kind", "string")
    reason = F.struct(ended.alias("kind"), F.when(ended == "aborted", F.struct(F.coalesce(inner, F.lit("unknown")).alias("kind"))).alias("reason"), F.when(ended == "error", F.try_variant_get(v, "$.reason.error.code", "string")).alias("code"))
    no_reason = F.concat(F.regexp_replace(json_of("turn/end", turn=_whole(v, "turn")), r"\}$", ""), F.lit(',"reason":null}'))
    snapshot = F.struct(
        _said(v, f"{GOAL}.id").alias("id"), _whole(v, f"{GOAL}.revision").alias("revision"), _said(v, f"{GOAL}.phase").alias("phase"), a.alias("objective"), _whole(v, f"{GOAL}.maxGoalRounds").alias("maxGoalRounds"),
        _whole(v, "roundsStarted").alias("roundsStarted"), _said(v, f"{GOAL}.blockedReason.code").alias("blockedReason"),
    )
    is_result = F.try_variant_get(v, f"$.{BLOCK}.type", "string") == "tool-result"
    made = _by_type({
        "user/message": F.when(F.col("_source") == "goal", json_of("goal-continuation", text=a)).otherwise(json_of("user", text=a)),
        "assistant/message": json_of("assistant", text=a),
        "tool/call": json_of("tool/call", name=a, callId=string("callId"), arguments=_filled(b)),
        "tool/result": json_of("tool/result", callId=F.coalesce(F.when(is_result, _said(v, f"{BLOCK}.toolCallId")), F.lit("")), isError=_is_true(v, f"{BLOCK}.isError"), text=a, error=F.when(F.coalesce(b, c).isNotNull(), F.struct(b.alias("name"), c.alias("code"))), meta=d),
        "turn/end": F.when(_is_record(v, "reason"), json_of("turn/end", turn=_whole(v, "turn"), reason=reason)).otherwise(no_reason),
        "goal/change": F.when(F.col("_word") == "clear", json_of("goal/change", operation=F.col("_word"), clearedId=F.nullif(_said(v, "cleared.id"), F.lit("")), clearedRevision=_whole(v, "cleared.revision")))
        .otherwise(json_of("goal/change", operation=F.col("_word"), goal=snapshot)),
        "todo/write": json_of("todo/write", status=F.when(F.size("_items") == 0, "cleared").otherwise("current"), todos=F.transform("_items", lambda i: F.struct(i["content"].alias("content"), i["status"].alias("status")))),
        "plan/mode": json_of("plan/mode", active=_is_true(v, "active")),
        "request/header": json_of("request/header", reason=F.col("_word"), provider=a, model=b, reasoningEffort=c),
        "agent-preset/selected": json_of("agent-preset/selected", preset=a),
        "compaction/start": json_of("compaction/start", compactionId=a, turn=_whole(v, "turn")),
        "compaction/end": json_of("compaction/end", compactionId=b, error=a),
        "command/run": json_of("command/run", commandId=string("commandId"), name=F.col("_word"), args=a, source=F.col("_source")),
    })
    none = F.array().cast(CUT)
    leaves = F.coalesce(F.col("_leaves.cut"), none)
    # Leaves are cut before the whole that they make up.
    cuts = F.when(_of("tool/call"), F.concat(F.array(cut("_a")), leaves, F.array(cut("_b")))).otherwise(F.concat(F.array(cut("_a"), cut("_b"), cut("_c")), leaves, F.array(cut("_d"))))
    listed = F.transform(F.filter("_items", lambda i: i["cut"]), lambda i: record(F.lit("todo/write.content"), F.lit(limits.state), i["content"]))
    truncation = F.coalesce(F.when(_of("todo/write"), listed).otherwise(F.filter(cuts, lambda x: x.isNotNull())), none)
    rows = once(rows, fields=made, truncation=truncation)
    shown = F.when(_of("user/message", "assistant/message", "tool/result"), a)
    kind = F.when(_of("user/message"), F.when(F.col("_source") == "goal", "goal-continuation").otherwise("user")).when(_of("assistant/message"), "assistant").otherwise(F.col("type"))
    return rows.select("session_id", "seq", "type", kind.alias("kind"), F.coalesce(shown, F.lit("")).alias("text"), "fields", "truncation")


VIEW = "struct<status: string, goal_id: string, revision: bigint, phase: string, objective: string>"


def goal_view() -> Column:
    """The view that a goal change states: cleared, or what its snapshot says; null if it states none."""
    v = F.try_parse_json("data")
    number = _whole(v, "goal.revision")
    named = {"goal_id": F.nullif(_said(v, "goal.id"), F.lit("")), "revision": F.when(number > 0, number), "phase": F.nullif(_said(v, "goal.phase"), F.lit("")), "objective": F.nullif(_said(v, "goal.objective"), F.lit(""))}
    current = F.struct(F.lit("current").alias("status"), *[c.alias(n) for n, c in named.items()]).cast(VIEW)
    cleared = F.struct(F.lit("cleared").alias("status"), *[F.lit(None).alias(n) for n in named]).cast(VIEW)
    operation = _said(v, "operation")
    return F.when(F.col("type") == "goal/change", F.when(operation == "clear", cleared).when(operation.isNotNull() & _is_record(v, "goal"), current))


def todo_view() -> Column:
    """The list that a TODO write states: an empty one is cleared; items without content go, and no status means pending."""
    items = F.try_variant_get(F.try_parse_json("data"), "$.todos", "array<variant>")
    read = F.transform(items, lambda i: F.struct(F.coalesce(_said(i, "content"), F.lit("")).alias("content"), F.coalesce(F.nullif(_said(i, "status"), F.lit("")), F.lit("pending")).alias("status")))
    good = F.filter(read, lambda i: i["content"] != "")
    view = F.struct(F.when(F.size(items) == 0, "cleared").otherwise("current").alias("status"), F.col("seq").alias("source_seq"), good.alias("items"))
    return F.when((F.col("type") == "todo/write") & items.isNotNull(), view)


def carried_views(base: DataFrame, log: DataFrame) -> DataFrame:
    """(session_id, goal, todo, through): views of a base carried on by what comes after it.

    `base`: the same columns; each session's facts count from its `through` on, and a fact of a seq at or below it is a replay. The
    newest fact of each view wins, a tombstone (cleared) as well as any other; a view without a newer one stays as it was. So carrying
    a log in any parts, one after the other, gives what carrying it at once gives.
    """
    facts = log.where(F.col("type").isin("goal/change", "todo/write")).select("session_id", "seq", goal_view().alias("goal"), todo_view().alias("todo"))
    seen = log.select("session_id", "seq", F.lit(None).cast(facts.schema["goal"].dataType).alias("goal"), F.lit(None).cast(facts.schema["todo"].dataType).alias("todo"))
    held = base.select("session_id", F.col("through").alias("seq"), F.col("goal").cast(facts.schema["goal"].dataType).alias("goal"), F.col("todo").cast(facts.schema["todo"].dataType).alias("todo"), F.lit(True).alias("_base"))
    fresh = facts.unionByName(seen.groupBy("session_id").agg(F.max("seq").alias("seq"), F.first("goal").alias("goal"), F.first("todo").alias("todo"))).withColumn("_base", F.lit(False))
    rows = fresh.unionByName(held).withColumn("_from", F.max(F.when(F.col("_base"), F.col("seq"))).over(Window.partitionBy("session_id")))
    rows = rows.where(F.col("_base") | F.col("_from").isNull() | (F.col("seq") > F.col("_from")))
    newest = lambda view: F.max_by(view, F.when(F.col(view).isNotNull(), F.col("seq"))).alias(view)
    return rows.groupBy("session_id").agg(newest("goal"), newest("todo"), F.max("seq").alias("through"))


def view_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, changed, cleared): views that say something else than before, in order, and those that were current and are cleared.

    Where a TODO list was written doesn't matter, what it says does; a view that never was is `none`.
    """
    old = before.select("session_id", F.col("goal").alias("_goal"), F.col("todo").alias("_todo"))
    rows = after.join(old, "session_id", "left")
    said = lambda c: F.struct(F.coalesce(c["status"], F.lit("none")), F.coalesce(c["items"], F.array().cast(ITEM)))
    differs = {"goal": ~F.col("goal").eqNullSafe(F.col("_goal")), "todo": ~said(F.col("todo")).eqNullSafe(said(F.col("_todo")))}
    gone = {name: differs[name] & (F.col(f"{name}.status") == "cleared") & (F.col(f"_{name}.status") == "current") for name in differs}
    listed = lambda which: F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in which.items()]))
    return rows.select("session_id", listed(differs).alias("changed"), listed(gone).alias("cleared"))


def authority_views(log: DataFrame) -> DataFrame:
    """(session_id, goal, todo): the newest fact of each wins; a session without one has null."""
    rows = log.where(F.col("type").isin("goal/change", "todo/write")).select("session_id", "seq", goal_view().alias("goal"), todo_view().alias("todo"))
    newest = lambda view: F.max_by(view, F.when(F.col(view).isNotNull(), F.col("seq"))).alias(view)
    return rows.groupBy("session_id").agg(newest("goal"), newest("todo"))


def urgent_events(log: DataFrame) -> DataFrame:
    """(session_id, seq, view): every TODO write, and goal changes that differ from the goal before them."""
    rows = log.where(F.col("type").isin("goal/change", "todo/write")).select("session_id", "seq", goal_view().alias("goal"), todo_view().alias("todo"))
    before = F.last("goal", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    view = F.when(F.col("todo").isNotNull(), "todo").when(F.col("goal").isNotNull() & ~F.col("goal").eqNullSafe(F.col("before")), "goal")
    return rows.withColumn("view", view).where("view is not null").select("session_id", "seq", "view")


def counted_windows(events: DataFrame, cursors: DataFrame, most: int) -> DataFrame:
    """(session_id, n, first_seq, source_cursor): the first `most` events above each session's cursor; none, no row."""
    above = events.join(cursors, "session_id").where(F.col("seq") > F.col("cursor"))
    ranked = above.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).where(F.col("r") <= most)
    return ranked.groupBy("session_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("source_cursor"))


def frame(events: list[dict], base: str) -> str:
    """The text that a fold sends: base, newest views of the events in it, and the events."""
    views = {e["type"]: e["seq"] for e in events if e["type"] in ("goal/change", "todo/write")}
    return json.dumps({"base": base, "views": views, "events": events}, ensure_ascii=False, separators=(",", ":"))


def byte_windows(events: DataFrame, most_events: int, most_bytes: int, base: str = "") -> DataFrame:
    """(session_id, outcome, n, source_cursor, bytes) of each session's next fold: a window, or infeasible if the first event alone is too large.

    A frame's size isn't the sum of its events' (views are resolved anew for each prefix), so a fold runs over the first
    `most_events` events of each session, and no others leave the JVM.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        held: list[dict] = []
        size = len(frame([], base).encode())
        outcome = "infeasible" if size > most_bytes else "window"
        if outcome == "window":
            for e in group.sort_values("seq").itertuples():
                if len(held) >= most_events:
                    break
                more = [*held, {"seq": int(e.seq), "type": e.type, "kind": e.kind, "text": e.text}]
                n = len(frame(more, base).encode())
                if n > most_bytes:
                    outcome, size = (outcome, size) if held else ("infeasible", n)
                    break
                held, size = more, n
        return pd.DataFrame([(int(group["session_id"].iloc[0]), outcome, len(held), held[-1]["seq"] if held else None, size)], columns=["session_id", "outcome", "n", "source_cursor", "bytes"]).astype({"source_cursor": "Int64"})

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    columns = events.select("session_id", "seq", "type", "kind", "text").withColumn("_place", place).where(F.col("_place") <= most_events).drop("_place")
    return columns.groupBy("session_id").applyInPandas(fold, "session_id long, outcome string, n long, source_cursor long, bytes long")


# How far a walk over a payload goes, and what binary leaves look like.
MOST_ITEMS, MOST_DEPTH = 8, 6
BINARY = re.compile(r"(?:[A-Za-z0-9+/]{16,}={0,2}|data:[^;,]{1,40};base64,)")


def _number(value: float) -> str:
    """A number as a script would write it: a double, its exponent without leading zeros."""
    try:
        value = float(value)
    except OverflowError:
        return "Infinity" if value > 0 else "-Infinity"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else re.sub(r"e([+-])0+", r"e\1", repr(value))


def _leaves(value: object, path: str, depth: int, most_items: int = MOST_ITEMS, most_depth: int = MOST_DEPTH) -> Iterator[tuple[str, str]]:
    """(path, text) of the leaves of a parsed value. Long arrays and deep values end in an ellipsis; blanks and base64 go."""
    if depth > most_depth:
        yield f"{path}…", "…"
    elif isinstance(value, str):
        if value.strip() and not BINARY.match(value.strip()):
            yield path, value
    elif isinstance(value, bool):
        yield path, str(value).lower()
    elif isinstance(value, (int, float)):
        yield path, _number(value)
    elif isinstance(value, list):
        for i, child in enumerate(value[:most_items]):
            yield from _leaves(child, f"{path}[{i}]", depth + 1, most_items, most_depth)
        if len(value) > most_items:
            yield f"{path}[{most_items}…]", "…"
    elif isinstance(value, dict):
        for key, child in value.items():
            yield from _leaves(child, f"{path}.{key}" if path else key, depth + 1, most_items, most_depth)


def _no_json(name: str) -> object:
    raise ValueError(name)


def rendered_leaves(limit: int):
    """A column function of (type, data): the leaves of a call's arguments or a result's meta as a JSON object, and those that were cut.

    The first of leaves with the same path counts. Arguments that are no JSON stay as they are.
    """
    made = f"struct<rendered: string, cut: {CUT}>"

    def bounded(value: str) -> tuple[str, bool]:
        raw = value.encode("utf-8", "surrogatepass")
        return (value, False) if len(raw) <= limit else (raw[: limit - text.ELLIPSIS_BYTES].decode("utf-8", "ignore") + text.ELLIPSIS, True)

    @F.pandas_udf(made)
    def leaves(types: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        def one(kind: str | None, payload: str | None) -> tuple[str | None, list[dict]]:
            if kind is None or payload is None:
                return None, []
            try:
                data = json.loads(payload)
            except (ValueError, RecursionError):
                return None, []
            if kind == "tool/call":
                raw = data.get("arguments")
                raw = raw.strip() if isinstance(raw, str) else ""
                try:
                    found = _leaves(json.loads(raw, parse_constant=_no_json), "", 0)
                except (ValueError, RecursionError):
                    return raw, []
            else:
                found = _leaves(data.get("meta"), "meta", 0)
            record: dict[str, str] = {}
            cut = []
            for path, value in found:
                kept, shorter = bounded(value)
                if shorter:
                    cut.append({"path": path, "limit_bytes": limit, "kept_bytes": len(kept.encode("utf-8", "surrogatepass"))})
                record.setdefault(path, kept)
            return (json.dumps(record, ensure_ascii=False, separators=(",", ":")) if record else ""), cut

        rows = [one(k, d) for k, d in zip(types, payloads, strict=True)]
        return pd.DataFrame({"rendered": [r[0] for r in rows], "cut": [r[1] for r in rows]})

    return leaves


def json_leaves(rows: DataFrame, column: str, most_items: int = MOST_ITEMS, most_depth: int = MOST_DEPTH) -> DataFrame:
    """`rows` with column leaves: a map from dotted paths to texts; texts that are no JSON have none."""

    @F.pandas_udf("map<string, string>")
    def leaves(texts: pd.Series) -> pd.Series:
        def one(raw: str | None) -> dict[str, str]:
            found: dict[str, str] = {}
            try:
                value = json.loads(raw) if raw else None
            except (ValueError, RecursionError):
                value = None
            for path, leaf in _leaves(value, "", 0, most_items, most_depth):
                found.setdefault(path, leaf)
            return found

        return texts.map(one)

    return rows.withColumn("leaves", leaves(column))
