"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm.common import few, gathered, let_go, materialise

#: A key with more than one row in so many is joined by broadcast; so there are fewer such keys than that.
CROWDED = 1000


def spread_join(rows: DataFrame, values: DataFrame, key: str, crowded: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `values`, of one row for each key; keys that hold many of the rows don't meet in one task.

    `crowded`: those keys, where they are known."""
    if crowded is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
        crowded = counts.where(F.col("_n") > 1 + rows.count() // CROWDED).select(key)
    crowded = materialise(crowded)
    if not crowded.head(1):
        return rows.join(values, key)
    few = F.broadcast(values.join(F.broadcast(crowded), key, "left_semi"))
    return rows.join(F.broadcast(crowded), key, "left_anti").join(values, key).unionByName(rows.join(few, key))


def _stars(links: DataFrame, both: bool, rows: int) -> DataFrame:
    """One star step: nodes hand their (larger, or smaller) neighbours to the least node they know. `rows`: of the links, at most."""
    if both:
        links = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = links.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    known = links.join(few(least, 2 * rows), "high")
    if both:
        return known.where(F.col("low") > F.col("high")).select(F.col("low").alias("high"), F.col("least").alias("low"))
    return known.select(F.explode(F.array("low", "high")).alias("high"), F.col("least").alias("low"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node that it reaches.

    Alternates large and small stars until nothing changes. Every round cuts its lineage in the shared folder, and a
    node with very many links is only ever a key of partial aggregates and of joins that Spark may split. Few links are in few
    partitions, and few nodes are broadcast.
    """
    links, rows = gathered(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    seen = None
    while True:
        links, rows = gathered(_stars(_stars(links, both=True, rows=rows), both=False, rows=rows).where("high <> low").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            roots = links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            return few(*gathered(links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)))
        seen = tuple(now)
        let_go(links.sparkSession)
