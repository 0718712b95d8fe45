"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns `VIRTUAL_NODES` points on a ring of 2^32 places; so the ring falls into shards x `VIRTUAL_NODES` arcs. A
row's place comes from a hash of its key, and its arc leads to the shards in the order in which they first appear
clockwise. A shard's bound is the floor or the ceiling of rows / shards (lower shard numbers take the remainder), so no
two shards differ by more than one row. All arcs ask their first shard for room, in order round the ring; rows that
overflow go on clockwise to the arc's next shard, and so on. Since the bounds add up to all rows, each finds a place.

Only counts are negotiated: one row for each cell. Cells cut arcs by a finer hash of key and text, into more of them the more rows
there are, so that a window sorts about `CELL_ROWS` rows at most whatever the input. Rows that repeat key and text more often than
that are told apart by where they stand in a checkpoint, and spread over the cells of their arc.

Null keys and null texts hash like empty ones. Rows are ranked by place, key and text, then by all their columns; repeated rows are
placed as often as they come. An empty table gives no rows. Other columns are kept, but for shard and slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.llm.common import materialise

VIRTUAL_NODES, CELL_ROWS = 128, 250_000
RING = 1 << 32


def ring(df: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(arc, top, route): the arcs of the ring, their last place, and the shards met clockwise from there, one of each."""
    session = df.sparkSession
    points = (
        session.range(shards)
        .select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("node"))
        .select("shard", F.pmod(F.xxhash64(F.lit("ring"), "shard", "node"), F.lit(RING)).alias("top"))
    )
    everyone = points.agg(F.sort_array(F.collect_list(F.struct("top", "shard"))).alias("points"))
    return everyone.select(F.posexplode("points").alias("arc", "point"), "points").select(
        "arc",
        F.col("point.top").alias("top"),
        F.array_distinct(
            F.transform(F.concat(F.slice("points", F.col("arc") + 1, F.lit(shards * virtual_nodes)), F.slice("points", 1, F.col("arc"))), lambda p: p["shard"])
        ).alias("route"),
    )


def _negotiated(cells: DataFrame, shards: int) -> DataFrame:
    """(arc, cell, round, shard, first, many, begin): a cell's rows from `first` on, `many` of them, go to that shard's slots from `begin` on."""
    whole = Window.partitionBy()
    total = F.sum("n").over(whole)
    state = cells.withColumns({"total": total, "left": F.col("n"), "taken": F.array_repeat(F.lit(0).cast("long"), shards)})
    rounds = []
    for k in range(shards):
        wanted = F.element_at("route", k + 1)
        room = F.floor(F.col("total") / shards) + F.when(wanted < F.col("total") % shards, 1).otherwise(0) - F.element_at("taken", wanted + 1)
        before = F.coalesce(F.sum("left").over(Window.partitionBy("want").orderBy("arc", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = state.withColumns({"want": wanted, "room": room}).withColumn("before", before)
        state = state.withColumn("got", F.greatest(F.lit(0).cast("long"), F.least(F.col("left"), F.col("room") - F.col("before"))))
        state = state.withColumn(f"round{k}", F.struct(F.col("want").alias("shard"), (F.col("n") - F.col("left")).alias("first"), F.col("got").alias("many"), (F.element_at("taken", F.col("want") + 1) + F.col("before")).alias("begin")))
        added = [F.sum(F.when(F.col("want") == s, F.col("got")).otherwise(0)).over(whole) for s in range(shards)]
        state = state.withColumns({"left": F.col("left") - F.col("got"), "taken": F.array(*[F.element_at("taken", s + 1) + a for s, a in enumerate(added)])})
        rounds.append(f"round{k}")
    return state.select("arc", "cell", F.explode(F.filter(F.array(*rounds), lambda r: r["many"] > 0)).alias("r")).select("arc", "cell", "r.*")


def _below(tops: list[int], place: Column) -> Column:
    """How many of these places are before a place. The ring falls into as many equal slices, so that only the few in its own are compared."""
    width = RING // len(tops) + 1
    slices = [[t for t in tops if t // width == s] for s in range(len(tops))]
    begun = [sum(map(len, slices[:s])) for s in range(len(tops))]
    at = F.floor(place / width).cast("int")
    inside = F.get(F.array(*[F.array(*map(F.lit, own)).cast("array<bigint>") for own in slices]), at)
    return F.get(F.array(*map(F.lit, begun)), at) + F.size(F.filter(inside, lambda t: t < place))


def bounded_ring(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of `df` with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    place = F.pmod(F.xxhash64(F.lit("key"), named), F.lit(RING))
    fine = F.xxhash64(F.lit("cell"), named, F.coalesce(F.col(text).cast("string"), F.lit("")))
    arcs = ring(df, shards, virtual_nodes)
    # As many numbers as the ring has points, by parameters alone.
    tops = sorted(r["top"] for r in arcs.select("top").collect())
    arc = F.pmod(_below(tops, F.col("place")), F.lit(len(tops)))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    dealt = df.select(F.struct(*kept).alias("row"), place.alias("place"), fine.alias("fine")).withColumn("arc", arc)
    same = dealt.groupBy("place", "fine").agg(F.count("*").alias("n"))
    cells = max(1, -(-2 * dealt.count() // (len(tops) * cell_rows)))
    # At most rows / cell_rows of them.
    crowds = same.where(F.col("n") > cell_rows).select("place", "fine", F.ceil(2 * F.col("n") / cell_rows).alias("parts"))
    if crowds.head(1):
        dealt = materialise(dealt).withColumn("at", F.monotonically_increasing_id()).join(crowds, ["place", "fine"], "left")
        part = F.when(F.col("parts").isNotNull(), F.pmod("at", "parts")).otherwise(F.pmod("fine", F.lit(cells)) - cells)
    else:
        part = F.pmod("fine", F.lit(cells)) - cells
    dealt = dealt.select("row", "place", "fine", "arc", part.alias("cell"))
    counts = dealt.groupBy("arc", "cell").agg(F.count("*").alias("n")).join(F.broadcast(arcs.select("arc", "route")), "arc")
    runs = _negotiated(counts, shards).groupBy("arc", "cell").agg(F.sort_array(F.collect_list(F.struct("first", "many", "begin", "shard"))).alias("runs"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("place", "fine", F.xxhash64("row"))) - 1)
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    found = ranked.join(runs, ["arc", "cell"]).select("row", "rank", run.alias("run"))
    return found.select("row.*", F.col("run.shard").alias("shard"), (F.col("run.begin") + F.col("rank") - F.col("run.first")).alias("slot"))
