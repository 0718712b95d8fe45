"""Where replacements come from: records read back field by field, kinds, coverage, and the events behind them however deep.

A replacement of a tool result is priced by the event just before it, which may carry a record of what was replaced. A record
counts only if all of it agrees with the log, the digest of the replacing text included; anything less proves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.files import settled
from loomstrand.operators.replay import SEEN

PRODUCER, VERSION = "loomstrand", 1
KINDS = ("tool-summary", "tool-pruned")
RECORD = "struct<producer: string, schema_version: bigint, kind: string, covered: array<bigint>, sources: array<bigint>, group_id: string, generation: bigint, digest: string>"


def _json_list(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ","), F.lit("]"))


def record_digest(kind: Column, covered: Column, sources: Column, group_id: Column, generation: Column, parts: Column) -> Column:
    """SHA-256 over a JSON list of eight texts: producer, version, kind, both lists of seqs, group, generation and the list of text
    parts, so that no two records share their input whatever separators their texts hold."""
    group = F.when(group_id.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(group_id)), r"^\[|\]$", ""))
    texts = F.to_json(F.coalesce(parts, F.array().cast("array<string>")))
    return F.sha2(F.to_json(F.array(F.lit(PRODUCER), F.lit(str(VERSION)), kind, _json_list(covered), _json_list(sources), group, generation.cast("string"), texts)), 256)


def group_fingerprint(lifecycle: Column, seqs: Column, call_ids: Column, types: Column, parts: Column, version: int = VERSION) -> Column:
    """SHA-256 of a tool group: its session's lifecycle, seqs, call ids and types in order, a digest of its texts, and the schema's version."""
    content = F.sha2(F.to_json(parts), 256)
    whole = F.struct(lifecycle.alias("lifecycle"), seqs.alias("sourceSeqs"), call_ids.alias("callIds"), types.alias("eventTypes"), content.alias("contentDigest"), F.lit(version).alias("schemaVersion"))
    return F.sha2(F.to_json(whole), 256)


def read_back(log: DataFrame) -> DataFrame:
    """(session_id, seq, record, fault) of every replaced tool result: its record, or why it has none that counts.

    `log`: (session_id, seq, type, covers, shadowed, record, parts): `shadowed` and `record` on pricing events, `parts` (texts) on results.
    Sessions without a gap in seq are taken for granted: the pricing event is the row of the seq before.
    """
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    generation = F.count_if(F.size("covers") > 0).over(Window.partitionBy("session_id"))
    before = {c: F.lag(c).over(by_seq) for c in ("seq", "type", "shadowed", "record")}
    rows = log.select("session_id", "seq", "type", "covers", "parts", generation.alias("now"), *[c.alias(f"before_{name}") for name, c in before.items()])
    rows = rows.where((F.col("type") == "tool/result") & (F.size("covers") > 0))
    record = F.col("before_record")
    covered, sources = record["covered"], record["sources"]
    good_list = lambda c: F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda s: s.isNull() | (s < 0)), F.lit(False))
    summary = record["kind"] == "tool-summary"
    named = F.coalesce(F.length(record["group_id"]) > 0, F.lit(False))
    digest = record_digest(record["kind"], covered, sources, record["group_id"], record["generation"], F.col("parts"))
    fault = (
        F.when(~(F.col("before_type").eqNullSafe("compaction/prune") & F.col("before_seq").eqNullSafe(F.col("seq") - 1)), "no-price")
        .when(record.isNull(), "no-record")
        .when(~record["producer"].eqNullSafe(PRODUCER), "foreign-producer")
        .when(~record["schema_version"].eqNullSafe(VERSION), "unknown-version")
        .when(~F.coalesce(record["kind"].isin(*KINDS), F.lit(False)), "unknown-kind")
        .when(~good_list(covered) | ~good_list(sources) | ~good_list(F.col("before_shadowed")), "malformed-seqs")
        .when(F.col("before_shadowed") != covered, "other-range")
        .when(F.size(F.array_except(covered, sources)) > 0, "uncited-cover")
        .when((F.array_max(sources) >= F.col("seq")) | (F.size(F.array_distinct(sources)) < F.size(sources)), "later-or-repeated-source")
        .when(F.when(summary, ~named).otherwise(record["group_id"].isNotNull()), "wrong-group")
        .when(~F.coalesce(record["generation"].between(0, F.col("now")), F.lit(False)), "wrong-generation")
        .when(~record["digest"].eqNullSafe(digest), "stale-digest")
    )
    return rows.select("session_id", "seq", F.when(fault.isNull(), record).alias("record"), fault.alias("fault"))


def source_kinds(log: DataFrame, claims: DataFrame | None = None, inherited_before: int = 0, reentry_turns: int = 1, immediate: bool = False) -> DataFrame:
    """(session_id, seq, kind, covered, turns_after, foldable) of every node that is or was shown.

    `claims`: (session_id, seq) of summaries that an audit says it served. They can only make a kind stricter: a claim that the
    record doesn't bear out leaves the node unknown. `covered` is null for what replaces nothing, what a record states, or else the
    seqs that the replacement itself cites. Replacements may be folded again after `reentry_turns` completed turns, or at once
    (`immediate`) unless they come from a session before this one (seq below `inherited_before`); unknown ones never.
    """
    later = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    done = (F.col("type") == "turn/end") & F.coalesce(F.col("reason") == "completed", F.lit(False))
    rows = log.select("session_id", "seq", "type", "source_kind", "covers", F.coalesce(F.count_if(done).over(later), F.lit(0)).alias("after")).where(F.col("type").isin(*SEEN))
    rows = rows.join(read_back(log).select("session_id", "seq", "record"), ["session_id", "seq"], "left")
    claimed = F.lit(False)
    if claims is not None:
        rows = rows.join(claims.select("session_id", "seq", F.lit(True).alias("_claimed")).distinct(), ["session_id", "seq"], "left")
        claimed = F.coalesce("_claimed", F.lit(False))
    replaces, said = F.size("covers") > 0, F.col("type") == "user/message"
    kind = (
        F.when(said & (F.col("source_kind") == "slot"), "task-state-slot")
        .when(said & replaces & (F.col("source_kind") == "checkpoint"), "history-summary")
        .when((F.col("type") != "tool/result") | ~replaces, "original")
        .when(F.col("record").isNull(), "unknown-replacement")
        .when(claimed & (F.col("record.kind") != "tool-summary"), "unknown-replacement")
        .otherwise(F.col("record.kind"))
    )
    rows = rows.withColumn("kind", kind).withColumn("turns_after", F.when(F.col("kind") == "original", 0).otherwise(F.col("after")).cast("long"))
    at_once = F.lit(immediate) & (F.col("seq") >= inherited_before) & F.col("kind").isin("tool-summary", "tool-pruned", "history-summary")
    foldable = (F.col("kind") != "unknown-replacement") & ((F.col("kind") == "original") | at_once | (F.col("turns_after") >= reentry_turns))
    covered = F.when(replaces, F.coalesce("record.covered", "covers"))
    return rows.select("session_id", "seq", "kind", covered.alias("covered"), "turns_after", foldable.alias("foldable"))


def origins(kinds: DataFrame) -> DataFrame:
    """(session_id, seq, origin, proven): the nodes behind every replacement that replace nothing themselves, through any number of
    replacements of replacements; `proven` where some way there has no unknown replacement in it.

    What a node covers must be earlier than itself, other citations are passed over. The ways between replacements are found first,
    by doubling, in as many rounds as the logarithm of the longest chain; one join then leads from them to the origins. A
    replacement of very many nodes is many rows of one join key, which a skewed join may split.
    """
    cites = kinds.where("covered is not null").select("session_id", "seq", F.explode(F.array_distinct("covered")).alias("cited"), (F.col("kind") != "unknown-replacement").alias("proven"))
    cites = cites.where("cited < seq")
    nodes = kinds.where("covered is not null").select("session_id", F.col("seq").alias("cited"), F.lit(True).alias("_inner"))
    edges = settled(cites.join(nodes, ["session_id", "cited"], "left"))
    inner = edges.where("_inner").select("session_id", "seq", "cited", "proven")
    ways = settled(inner)
    size = lambda df: tuple(df.agg(F.count("*"), F.count_if("proven")).first())
    before, now = None, size(ways)
    while now != before:
        first = ways.select("session_id", "seq", F.col("cited").alias("_mid"), F.col("proven").alias("_first"))
        second = ways.select("session_id", F.col("seq").alias("_mid"), "cited", F.col("proven").alias("_second"))
        longer = first.join(second, ["session_id", "_mid"]).select("session_id", "seq", "cited", (F.col("_first") & F.col("_second")).alias("proven"))
        ways = settled(ways.unionByName(longer).groupBy("session_id", "seq", "cited").agg(F.bool_or("proven").alias("proven")))
        before, now = now, size(ways)
    itself = edges.select("session_id", "seq").distinct().select("session_id", "seq", F.col("seq").alias("cited"), F.lit(True).alias("proven"))
    reached = ways.unionByName(itself).select("session_id", F.col("seq").alias("from"), F.col("cited").alias("seq"), F.col("proven").alias("way"))
    leaves = edges.where("_inner is null").select("session_id", "seq", F.col("cited").alias("origin"), "proven")
    out = reached.join(leaves, ["session_id", "seq"]).select("session_id", F.col("from").alias("seq"), "origin", (F.col("way") & F.col("proven")).alias("proven"))
    return out.groupBy("session_id", "seq", "origin").agg(F.bool_or("proven").alias("proven"))


def replacement_coverage(log: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, kind, covered, origins, proven): every replacement, the seqs that it covers as text, how many nodes are behind
    it in the end, and how many of them it is proven to stand for."""
    kinds = source_kinds(log, claims)
    counts = origins(kinds).groupBy("session_id", "seq").agg(F.count("*").alias("origins"), F.count_if("proven").alias("proven"))
    zero = F.lit(0).cast("long")
    rows = kinds.where("covered is not null").join(counts, ["session_id", "seq"], "left")
    return rows.select("session_id", "seq", "kind", F.array_join(F.col("covered").cast("array<string>"), ",").alias("covered"), F.coalesce("origins", zero).alias("origins"), F.coalesce("proven", zero).alias("proven"))


def unrecorded_landings(log: DataFrame, audit: DataFrame) -> DataFrame:
    """(session_id, group_id) of summaries that the log proves and no audit row (session_id, fingerprint) knows, once for each group."""
    landed = read_back(log).where("record.kind = 'tool-summary'").select("session_id", F.col("record.group_id").alias("group_id")).distinct()
    known = audit.select("session_id", F.col("fingerprint").alias("group_id"))
    return landed.join(known, ["session_id", "group_id"], "left_anti")
