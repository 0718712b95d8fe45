"""Session logs derived from the given tables, and readers of stored logs.

A log row has session_id, seq (dense from 0) and type. A surface row is a log row that the model sees, with its position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.functions.text import token_estimate

#: Explicit schema of a stored log: payloads stay JSON text and are parsed where they are needed.
LOG_SCHEMA = T.StructType(
    [T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), T.StructField("data", T.StringType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A log stored as one JSON object a line; lines that don't parse give null columns."""
    raw = spark.read.text(path)
    parsed = F.from_json("value", "session_id long, seq long, type string, data variant")
    return raw.select(parsed.alias("e")).select("e.session_id", "e.seq", "e.type", F.to_json("e.data").alias("data"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a stored log; what is there never changes."""
    rows.write.mode("append").parquet(path)


def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each conversation; all rows are on the surface."""
    rows = table(spark, sf_dir, "conversations")
    by_turn = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("role") == "assistant", "model").when(F.col("role") == "system", "plugin").otherwise("user")
    return rows.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "assistant/message").otherwise("user/message").alias("type"),
        kind.alias("source_kind"),
        F.when(F.col("role") == "assistant", F.count_if(F.col("role") == "user").over(by_turn)).alias("turn"),
        F.lit(None).cast("long").alias("step"),
        F.lit(0).cast("long").alias("tool_calls"),
        F.length("text").cast("long").alias("chars"),
        token_estimate("text").alias("tokens"),
        "text",
    )


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each user: clicks and views call tools, purchases answer, errors end a turn, signups speak."""
    event_no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    results = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", F.col("k") % 3 + 1).otherwise(0)
    numbered = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type", k.alias("k"), event_no.alias("ev_no"))
    spread = numbered.withColumn("n_res", results).select("*", F.explode(F.sequence(F.lit(0), F.col("n_res").cast("int"))).alias("sub"))
    typed = (
        F.when(F.col("event_type") == "signup", "user/message")
        .when(F.col("event_type") == "error", "turn/end")
        .when(F.col("sub") > 0, "tool/result")
        .otherwise("assistant/message")
    )
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    rows = spread.select(
        "*",
        typed.alias("type"),
        F.when(F.col("event_type") == "error", F.when(F.col("k") % 2 == 0, "completed").otherwise("error")).alias("reason"),
        (F.row_number().over(Window.partitionBy("session_id").orderBy("ev_no", "sub")).cast("long") - 1).alias("seq"),
    )
    ended = F.coalesce(F.count_if(F.col("type") == "turn/end").over(by_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chars = F.when(F.col("type") == "tool/result", 200 + (F.col("event_id") * 37 + F.col("sub") * 101) % 9000).otherwise(40 + F.col("event_id") % 200)
    spoken = F.col("type").isin("assistant/message", "tool/result")
    return rows.withColumn("chars", chars).select(
        "session_id",
        "seq",
        "type",
        "reason",
        F.when(F.col("type") != "user/message", ended).alias("turn"),
        F.when(spoken, F.col("ev_no")).alias("step"),
        F.when(F.col("type") == "assistant/message", F.col("n_res")).otherwise(0).cast("long").alias("tool_calls"),
        "chars",
        (F.floor((F.col("chars") + 3) / 4) + 8).cast("long").alias("tokens"),
        "k",
    )


def surface_of(log: DataFrame) -> DataFrame:
    """The rows of an append-only log that the model sees, with positions."""
    seen = log.where(F.col("type").isin("user/message", "assistant/message", "tool/result"))
    return seen.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).cast("long") - 1)


def authority_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal changes (signups; k = 0 clears) and whole-list TODO writes (views; every fifth k clears), as JSON payloads."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), seq.alias("seq"), "event_type", "event_id", k.alias("k"))
    revision = F.count_if(F.col("event_type") == "signup").over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("revision", revision)
    goal = F.when(F.col("k") == 0, F.to_json(F.struct(F.lit("clear").alias("operation")))).otherwise(
        F.to_json(F.struct(F.lit("set").alias("operation"), F.struct(F.concat(F.lit("g"), F.col("k") % 7).alias("id"), "revision", F.concat(F.lit("objective "), "event_id").alias("objective")).alias("goal")))
    )
    item = F.struct(F.concat(F.lit("task "), "event_id").alias("content"), F.when(F.col("k") % 2 == 0, "done").otherwise("").alias("status"))
    todo = F.to_json(F.struct(F.when(F.col("k") % 5 == 0, F.array().cast("array<struct<content: string, status: string>>")).otherwise(F.array(item)).alias("todos")))
    return rows.select(
        "session_id",
        "seq",
        F.when(F.col("event_type") == "signup", "goal/change").when(F.col("event_type") == "view", "todo/write").otherwise("other").alias("type"),
        F.when(F.col("event_type") == "signup", goal).when(F.col("event_type") == "view", todo).alias("data"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of attempts: one for each event, whose outcome and error come from its number."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", k.alias("k"), F.floor(F.col("event_id") / 3).alias("time"))
    outcomes = F.array(*[F.lit(x) for x in ("success", "failure", "manual", "terminal-infeasible", "aborted", "repair", "failure", "open")])
    codes = F.array(*[F.lit(x) for x in ("BUDGET", "ABORTED", "SCHEMA", "TIMEOUT", "SERVICE_DISPOSED")])
    outcome = F.element_at(outcomes, (F.col("k") % 8 + 1).cast("int"))
    return rows.select(
        "session_id",
        F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("request_id"),
        "time",
        F.nullif(outcome, F.lit("open")).alias("outcome"),
        F.when(outcome == "failure", F.element_at(codes, (F.col("event_id") % 5 + 1).cast("int"))).alias("code"),
        (F.col("event_id") % 40).alias("revision"),
    )


def audit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writers do to audit rows, five operations a request: rows are opened (or not), finished, and settled by repairs whose
    lifecycle, revision or certificate don't always agree."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type", place.alias("op_no"), k.alias("k"))
    request, k = F.floor(F.col("op_no") / 5), F.col("k")
    opens = F.when(F.col("op_no") % 5 == 0, k % 11 != 0).otherwise(F.col("event_type") == "signup")
    outcomes = F.array(*[F.lit(x) for x in ("success", "repair", "failure", "aborted")])
    one_if = lambda condition: condition.cast("long")
    stable = request + one_if(k % 7 == 0)
    return rows.select(
        "session_id", F.concat(F.lit("q"), request.cast("string")).alias("request_id"), "op_no",
        F.when(opens, "open").when(F.col("event_type").isin("purchase", "error"), "settle").otherwise("finish").alias("op"),
        (F.col("session_id") * 10 + one_if(k % 13 == 0)).alias("created_at"),
        F.when(F.col("session_id") % 4 != 0, F.concat(F.lit("dir"), one_if(k % 17 == 0))).alias("cwd"),
        request.alias("revision"), F.when(~opens & (k % 29 != 0), F.element_at(outcomes, (k % 4 + 1).cast("int"))).alias("outcome"),
        (stable + one_if(k % 19 == 0)).alias("end_revision"), (k + one_if(k % 23 == 0)).alias("end_cursor"), stable.alias("stable_revision"), k.alias("stable_cursor"),
    )


def group_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-group audit rows: five fingerprints a session, six states, claims of landed replacements."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    states = F.array(*[F.lit(x) for x in ("open", "success", "failure", "fallback", "aborted", "repaired")])
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("session_id"), "event_id", k.alias("k"))
    return rows.select(
        "session_id",
        F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("request_id"),
        F.concat(F.lit("f"), F.col("event_id") % 5).alias("fingerprint"),
        F.element_at(states, (F.col("k") % 6 + 1).cast("int")).alias("status"),
        F.when(F.col("k") % 4 != 0, F.col("k") % 3 + 1).alias("attempt"),
        F.when(F.col("event_id") % 2 == 0, "me").otherwise("other").alias("owner_id"),
        F.when(F.col("k") % 6 == 0, F.lit(None).cast("string")).when(F.col("k") % 7 == 0, "interrupted-attempt").alias("diagnostic"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.col("event_id") % 11, F.col("event_id") % 11 + 1)).otherwise(F.array().cast("array<bigint>")).alias("claims"),
    )


def block_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results made of documents, as JSON contents: a text, a result with texts, an image and an inner result, another text; some
    lack the result, have nothing but an image in it, or hold no text at all."""
    rows = table(spark, sf_dir, "documents")
    text, n, k = F.coalesce(F.col("text"), F.lit("")), F.length(F.coalesce(F.col("text"), F.lit(""))), F.col("doc_id")
    part = lambda a, b: F.substring(text, (F.floor(n * a / 100) + 1).cast("int"), (F.floor(n * b / 100) - F.floor(n * a / 100)).cast("int"))
    said = lambda a, b: F.to_json(F.struct(F.lit("text").alias("type"), part(a, b).alias("text")))
    joined = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    image = F.concat(F.lit('{"type":"image","data":"i'), k.cast("string"), F.lit('"}'))
    result = lambda name, *items: F.concat(F.lit(f'{{"type":"tool-result","toolCallId":"{name}","content":'), joined(*items), F.lit("}"))
    full = joined(said(0, 15), result("a", said(15, 40), image, result("in", said(40, 55)), said(55, 60)), image, said(60, 90), result("b", said(90, 100), image))
    content = F.when(k % 7 == 3, joined(said(0, 50), image, said(50, 100))).when(k % 7 == 5, joined(result("c", image))).when(k % 11 == 4, joined(said(0, 0), result("d", said(0, 0), said(0, 100)))).otherwise(full)
    return rows.select((k % 50).alias("session_id"), (F.row_number().over(Window.partitionBy(k % 50).orderBy(k)).cast("long") - 1).alias("pos"), k.alias("seq"), (k % 3 == 0).alias("recent"), content.alias("content"))


def replaced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool log with appended replacements: a prune for every long result, a summary of the oldest nodes, and in every third
    session a summary of that summary. Column covers lists what a replacement takes the place of; shadow is a prune event's target."""
    log = tool_log(spark, sf_dir)
    none = F.array().cast("array<bigint>")
    size = log.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if((F.col("type") == "tool/result") & (F.col("chars") > 7000)).alias("m"))
    base = log.select("session_id", "seq", "type", "reason", F.lit(None).cast("string").alias("source_kind"), none.alias("covers"), F.lit(None).cast("long").alias("shadow"))
    long = log.where("type = 'tool/result' and chars > 7000").select("session_id", "seq", (F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).cast("long") - 1).alias("i"))
    long = long.join(size, "session_id")
    null = F.lit(None).cast("string")
    prunes = long.select("session_id", (F.col("n") + 2 * F.col("i")).alias("seq"), F.lit("compaction/prune").alias("type"), null.alias("reason"), null.alias("source_kind"), none.alias("covers"), F.col("seq").alias("shadow"))
    results = long.select(
        "session_id", (F.col("n") + 2 * F.col("i") + 1).alias("seq"), F.lit("tool/result").alias("type"), null.alias("reason"), null.alias("source_kind"), F.array("seq").alias("covers"), F.lit(None).cast("long").alias("shadow")
    )
    oldest = surface_of(log).where("pos < 9").join(long.select("session_id", "seq", "i"), ["session_id", "seq"], "left").join(size, "session_id")
    now = F.when(F.col("i").isNull(), F.col("seq")).otherwise(F.col("n") + 2 * F.col("i") + 1)
    first = oldest.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", now.alias("now")))), lambda s: s["now"]).alias("covers"), F.max(F.col("n") + 2 * F.col("m")).alias("seq"))
    summary = lambda rows: rows.select("session_id", "seq", F.lit("user/message").alias("type"), null.alias("reason"), F.lit("checkpoint").alias("source_kind"), "covers", F.lit(None).cast("long").alias("shadow"))
    second = first.where("session_id % 3 = 0").select("session_id", F.array("seq").alias("covers"), (F.col("seq") + 1).alias("seq"))
    return base.unionByName(prunes).unionByName(results).unionByName(summary(first)).unionByName(summary(second))


def attempt_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(asks, audit, landings, unwritten) of three groups a session: views ask, clicks open rows, some purchases prove landings, some
    errors are attempts that no row records."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.concat(F.lit("f"), F.col("event_id") % 9).alias("fingerprint"), "event_id", "event_type", k.alias("k"))
    states = F.array(*[F.lit(x) for x in ("success", "failure", "fallback", "aborted", "failure", "repaired")])
    number, k = F.col("event_id"), F.col("k")
    audit = rows.where("event_type = 'click' and k % 4 <> 1").select(
        "session_id", "fingerprint", number.alias("opened"), F.when(k % 5 != 0, number + k * 40).alias("ended"), F.element_at(states, (k % 6 + 1).cast("int")).alias("status"),
        F.when(k % 4 != 0, k % 3).alias("attempt"), F.when(k % 7 == 0, F.array(number)).otherwise(F.array().cast("array<bigint>")).alias("claims"),
    )
    plain = lambda where: rows.where(where).select("session_id", "fingerprint", number.alias("time"))
    return plain("event_type = 'view'"), audit, plain("event_type = 'purchase' and event_id % 11 = 0"), plain("event_type = 'error' and k % 2 = 0")


def provenance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with replacements, whose pricing events say what was shadowed and carry records; of seventeen kinds of record twelve
    disagree with the log in one way or another."""
    from loomstrand.operators.lineage import PRODUCER, RECORD, VERSION, record_digest

    log, v, at = replaced_log(spark, sf_dir), (F.col("session_id") * 7 + F.col("seq")) % 17, F.col("shadow")
    replaced, summary, none = (F.col("type") == "tool/result") & (F.size("covers") > 0), at % 2 == 0, F.array().cast("array<bigint>")
    kind = F.when(v == 4, "other").when(summary, "tool-summary").otherwise("tool-pruned")
    covered = F.when(v == 5, F.array(at + 1)).when(v == 12, none).otherwise(F.array(at))
    cited = F.when(v == 6, F.array(at + 1)).when(v == 7, F.array(at, F.col("seq") + 5)).when(v == 11, F.array(at, at)).when(at > 0, F.array(at, at - 1)).otherwise(F.array(at))
    group = F.when(v == 8, F.when(summary, "").otherwise("g")).when(summary, F.concat(F.lit("f"), at % 5))
    generation = F.when(v == 9, 99_999).otherwise(0).cast("long")
    text = lambda seq: F.array(F.concat(F.lit('kept "text" '), seq))
    digest = F.when(v == 10, "stale").otherwise(record_digest(kind, covered, cited, group, generation, text(F.col("seq") + 1)))
    fields = {"producer": F.when(v == 2, "other").otherwise(PRODUCER), "schema_version": F.when(v == 3, 2).otherwise(VERSION), "kind": kind, "covered": covered, "sources": cited, "group_id": group, "generation": generation, "digest": digest}
    record = F.when(at.isNotNull() & (v != 1), F.struct(*[c.alias(n) for n, c in fields.items()]).cast(RECORD))
    return log.select("session_id", "seq", "type", "reason", "source_kind", "covers", F.when(at.isNotNull(), F.array(at)).alias("shadowed"), record.alias("record"), F.when(replaced, text(F.col("seq"))).alias("parts"))


def lock_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction starts (clicks), ends (views) of three locks, and seeds (errors whose k is a multiple of nine)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type", k.alias("k"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1).alias("seq"))
    kind = F.when(F.col("event_type") == "click", "compaction/start").when(F.col("event_type") == "view", "compaction/end").when((F.col("event_type") == "error") & (F.col("k") % 9 == 0), "session/end-seed").otherwise("other")
    return rows.select("session_id", "seq", kind.alias("type"), (F.col("k") % 3).alias("lock_id"))


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw events with JSON payloads."""
    rows = table(spark, sf_dir, "conversations")
    source = F.struct(F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 2, "goal").otherwise("user")).when(F.col("role") == "system", "plugin").otherwise("model").alias("kind"))
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    spoken = F.col("role") == "assistant"
    message = F.when(spoken, F.struct(content.alias("content")))
    payload = F.to_json(F.struct(source.alias("source"), F.when(~spoken, content).alias("content"), message.alias("message"), (F.col("turn") % 7 == 3).alias("interrupted")))
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "assistant/message").otherwise("user/message").alias("type"), payload.alias("data"))


def marker_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls (clicks), tool results (views), ends of turns (errors) and markers of six types (signups) with JSON payloads.

    Some arguments are no JSON or longer than their limit, some results are empty, some markers state nothing.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), seq.alias("seq"), "event_type", "event_id", "props", k.alias("k"))
    k, number = F.col("k"), F.col("event_id").cast("string")
    every = lambda n, c: F.when(k % n == 0, c)
    pack = lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    named = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    arguments = F.when(k % 9 == 0, F.concat(F.lit("raw "), F.repeat(F.lit("xé"), 1500))).when(k % 4 == 0, F.concat(F.lit(" not json "), number)).otherwise(F.col("props"))
    block = named(type=F.lit("tool-result"), toolCallId=F.concat(F.lit("c"), number), isError=k % 2 == 0, content=F.array(named(type=F.lit("text"), text=F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("result "), number)))))
    error = every(5, named(name=F.lit("ToolError"), code=F.when(k % 2 == 0, F.concat(F.lit("E"), k % 3))))
    meta = every(3, named(k=k, note=F.repeat(F.lit("no "), F.when(k % 2 == 0, 250).otherwise(2).cast("int"))))
    reason = named(
        kind=F.element_at(F.array(F.lit("completed"), F.lit("aborted"), F.lit("error")), (k % 3 + 1).cast("int")), reason=F.when((k % 3 == 1) & (k % 2 == 0), named(kind=F.lit("user"))), error=F.when((k % 3 == 2) & (k % 2 == 0), named(code=F.lit("E1")))
    )
    config = named(provider=F.lit("p"), model=F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("m"), k % 3)), reasoningEffort=every(2, F.lit("high")))
    header = pack(reason=F.when(k % 4 == 0, "series").when(k % 4 == 1, "change").otherwise("initial"), header=named(config=config))
    markers = {
        "request/header": header,
        "agent-preset/selected": pack(agentPreset=F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("preset "), k))),
        "compaction/start": pack(compactionId=F.concat(F.lit("z"), number), turn=every(2, k)),
        "compaction/end": pack(compactionId=F.concat(F.lit("z"), number), error=every(2, F.repeat(F.lit("boom "), 100))),
        "plan/mode": pack(active=k % 2 == 0),
        "command/run": pack(commandId=F.concat(F.lit("r"), number), name=F.when(k % 5 == 0, "other").when(k % 2 == 0, "plan").otherwise("goal"), args=every(3, F.lit("go on")), source=named(kind=F.lit("user"))),
    }
    names = list(markers)
    marked = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "tool/call").when(F.col("event_type") == "view", "tool/result").when(F.col("event_type") == "error", "turn/end").when(F.col("event_type") == "signup", marked).otherwise("other")
    rows = rows.withColumn("type", kind)
    data = F.when(F.col("type") == "tool/call", pack(name=F.concat(F.lit("tool_"), k % 5), callId=F.concat(F.lit("c"), number), arguments=arguments))
    data = data.when(F.col("type") == "tool/result", pack(message=named(content=F.array(block)), error=error, meta=meta)).when(F.col("type") == "turn/end", pack(turn=k, reason=reason))
    for name, payload in markers.items():
        data = data.when(F.col("type") == name, payload)
    return rows.select("session_id", "seq", "type", data.alias("data"))


def group_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, fingerprint, landed): replacements that the log proves, for the groups of some buyers."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase' and event_id % 4 = 0")
    return rows.groupBy(F.col("user_id").alias("session_id"), F.concat(F.lit("f"), F.col("event_id") % 5).alias("fingerprint")).agg(F.sort_array(F.collect_set(F.col("event_id") % 11)).alias("landed"))


def control_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as they arrive: signups carry a whole baseline, purchases an update; errors are updates that clear."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase', 'error')")
    return rows.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("arrival"),
        F.when(F.col("event_type") == "signup", "baseline").otherwise("update").alias("kind"),
        (k + F.col("event_id") % 17).alias("revision"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("state "), "event_id")).alias("stable"),
    )


def mirror_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight hosts as they arrive: a host opens its stream anew every 400 events, the first 60 of which make the opening
    baseline (in every seventh generation an empty one); errors carry no state."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("host"), F.col("user_id").alias("session_id"), "event_id", "event_type", k.alias("k"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("event_id")).cast("long") - 1
    rows = rows.withColumn("arrival", place).withColumn("generation", F.floor(F.col("arrival") / 400))
    opening, empty = F.col("arrival") % 400 < 60, F.col("generation") % 7 == 6
    held = rows.where(~(opening & empty & (F.col("arrival") % 400 > 0)))
    opens_empty = opening & empty
    return held.select(
        "host", "generation", "arrival", F.when(opening, "baseline").otherwise("update").alias("kind"), F.when(~opens_empty, F.col("session_id")).alias("session_id"),
        F.when(~opens_empty & (F.col("event_type") != "error"), F.col("k") + F.col("event_id") % 17).alias("revision"),
        F.when(~opens_empty & (F.col("event_type") != "error"), F.concat(F.lit("state "), "event_id")).alias("stable"),
    )


def slot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States to show: the newest goal and TODO list of each session, its last six purchases as facts, and its newest event."""
    from loomstrand.operators.events import authority_views

    log = authority_log(spark, sf_dir)
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    ranked = bought.select(F.col("user_id").alias("session_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("r")).where("r <= 6")
    facts = ranked.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list("event_id")), lambda i: F.concat(F.lit("fact about purchase "), i)).alias("facts"))
    none = F.array().cast("array<string>")
    counts = log.groupBy("session_id").agg(F.max("seq").alias("last"))
    return (
        authority_views(log)
        .join(facts, "session_id", "left")
        .join(counts, "session_id")
        .select(
            "session_id", "goal", "todo", F.coalesce("facts", none).alias("facts"), none.alias("decisions"), none.alias("constraints"), none.alias("risks"),
            (F.col("session_id") % 9 + 1).alias("revision"), (F.col("last") - F.col("session_id") % 2).alias("source_cursor"), F.col("last").alias("high_water"), F.md5(F.col("session_id").cast("string").cast("binary")).alias("digest"),
        )
    )


def slot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible slots: purchases whose k is a multiple of 23, at their place among the session's events; a fifth are another lifecycle's."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), place.alias("pos"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 != 0).alias("own"), "event_type", k.alias("k"))
    return rows.where("event_type = 'purchase' and k % 23 = 0").select("session_id", "pos", "seq", "own", F.concat(F.lit("state "), F.col("session_id") % 2).alias("text"))


def summary_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, inputs) of groups of ten events: inputs are all events, items leave some out, repeat some, and claim what isn't there."""
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("group_id"), "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), "props")
    inputs = rows.select("group_id", F.col("event_id").alias("source_seq"), F.concat(F.lit("c"), F.col("event_id") % 100).alias("call_id"), F.concat_ws(" ", "event_type", "props").alias("content"))
    claim = F.when(F.col("k") % 31 == 0, F.lit("invented")).when(F.col("k") % 37 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    items = rows.where("k % 29 <> 0").select(
        "group_id",
        F.when(F.col("k") % 41 == 0, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")).alias("source_seq"),
        F.when(F.col("k") % 3 == 0, F.when(F.col("k") % 43 == 0, "other").otherwise(F.concat(F.lit("c"), F.col("event_id") % 100))).alias("call_id"),
        F.array(claim).alias("claims"),
        F.when(F.col("k") % 47 == 0, 2).otherwise(1).alias("times"),
    )
    return items.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times"), inputs


def entry_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, base): entries of four kinds for each user; candidates echo, move, change, repeat and add some."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), "event_type")
    kinds = F.array(*[F.lit(x) for x in ("fact", "decision", "constraint", "risk")])
    kind = F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int"))
    words = F.concat(F.lit("entry "), F.col("event_id") % 13)
    base = rows.where("event_type = 'view'").select("session_id", F.concat(F.lit("e"), "event_id").alias("id"), kind.alias("kind"), words.alias("content"))
    candidates = rows.where("event_type in ('view', 'click')").select(
        "session_id",
        F.when(F.col("k") % 19 == 0, "risk").otherwise(kind).alias("kind"),
        F.col("event_id").alias("ordinal"),
        F.when(F.col("event_type") == "view", F.when(F.col("k") % 7 != 0, F.concat(F.lit("e"), "event_id"))).when(F.col("k") % 17 == 0, F.concat(F.lit("e"), "event_id")).alias("id"),
        F.when(F.col("k") % 23 == 0, F.concat(words, F.lit(" changed"))).otherwise(words).alias("content"),
    )
    return candidates, base


def cursor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's record claims: cursors and boundaries from counts of event kinds."""
    kinds = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(kinds("click").alias("c"), kinds("view").alias("v"), kinds("error").alias("e"))
    boundary = F.when(F.col("session_id") % 3 != 0, F.col("e"))
    return rows.select(
        "session_id", F.when(F.col("c") % 4 != 0, F.col("c")).alias("stable_cursor"), F.when(F.col("v") % 3 == 0, F.col("v")).alias("terminal_cursor"),
        F.when(F.col("session_id") % 5 < 3, boundary).when(F.col("session_id") % 5 == 3, F.col("e") + 1).alias("marker"), boundary.alias("boundary"),
    )
