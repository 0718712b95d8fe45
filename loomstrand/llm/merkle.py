"""Merkle manifest of a dataset: a tree of runs of three for each source, and one tree over the sources.

Every row is a leaf, the digest H of its fields. Leaves of a source ascend by id; while several nodes remain, every three
neighbours (the last run may be shorter, even one) become H of their digests. What remains is the source's subroot, and
the subroots in order of source (null first, then by bytes) make a tree of the same kind, whose end is the root.

Trees are cut into blocks of `LEVELS` levels. A block is stored as one row of raw digests in van Emde Boas order: a tree of h levels
is its upper half and then the lower subtrees from left to right, each laid out the same way, so that a path from leaf to root
touches few stretches whatever the size of a cache line or page. Places are computed, never looked up (`address`). A block's
root is its first digest; the roots of blocks are the leaves of the next tier of blocks, until a tree has one block.
Proofs go the other way: a tier hands each of its leaves the siblings on the way to the root, and the lowest tier reads
off its own siblings, appends what it was handed, and folds every leaf (as it is now) up to the root.

Ranks come from a range partition by (source, id) and the counts of its parts, so no task holds a whole source. Ids that repeat
are ordered by their leaf digests, null ids come first. Null and empty fields are told apart; repeated rows are leaves of
their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.llm.common import materialise

RUN, LEVELS = 3, 8
WIDTH = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def nodes_in(levels: int) -> int:
    """Nodes of a full tree."""
    return (RUN**levels - 1) // (RUN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of nodes of one depth (the root's is 0), counted from the left.

    The tree falls at half its height: a node of the upper half is looked for there; of the lower half, in the subtree that its
    number leads to, behind the upper half and the subtrees to the left.
    """
    place, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, below = levels - upper, depth - upper
        subtree, index = np.divmod(index, RUN**below)
        place += nodes_in(upper) + subtree * nodes_in(lower)
        levels, depth = lower, below
    return place


def leaves_in(levels: int) -> int:
    """Leaves of a full tree."""
    return RUN ** (levels - 1)


def height_for(leaves: int) -> int:
    """Levels of the smallest tree for so many leaves."""
    levels = 1
    while leaves_in(levels) < leaves:
        levels += 1
    return levels


def hashed(parts: str) -> bytes:
    return hashlib.sha256(parts.encode()).digest()


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """A block in van Emde Boas order; a place without a node is zeros."""
    store = np.zeros((nodes_in(levels), WIDTH), np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        store[address(levels, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, WIDTH)
        row = [hashed("".join(x.hex() for x in row[i : i + RUN])) for i in range(0, len(row), RUN)]
    return store.tobytes()


def siblings(nodes: bytes, levels: int, leaves: int) -> Iterator[list[tuple[str, str]]]:
    """For each level from the leaves on, the (left, right) siblings of every node of it, as hex text."""
    store = np.frombuffer(nodes, np.uint8).reshape(-1, WIDTH)
    count = leaves
    for depth in range(levels - 1, 0, -1):
        digests = [x.tobytes().hex() for x in store[address(levels, depth, np.arange(count))]]
        level = []
        for i in range(count):
            run = i - i % RUN
            level.append(("".join(digests[run:i]), "".join(digests[i + 1 : run + RUN])))
        yield level
        count = -(-count // RUN)


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """`rows` with idx, the place in their tree by `order` (nulls first), and total, the tree's number of leaves.

    A tree may hold a third of all rows or more: rows are dealt by ranges of (tree, order), and counts of (part, tree) place the parts.
    """
    dealt = materialise(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order))
    at = F.monotonically_increasing_id()
    dealt = dealt.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    counts = dealt.groupBy("_part", tree).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", tree, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    return dealt.join(starts, ["_part", tree]).select(*[c for c in rows.columns], (F.col("_at") + F.col("_shift")).alias("idx"), "total")


def tiers(entries: DataFrame, kept: dict[str, str], full: int = LEVELS) -> list[DataFrame]:
    """Blocks of all trees, lowest tier first: (tree, block, total, levels, nodes, and a list for each kept column in leaf order).

    `entries`: (tree, idx, digest, total, ...); `kept`: names and types of further columns that the lowest blocks carry; `full`: levels
    of a block.
    """
    found: list[DataFrame] = []
    size = leaves_in(full)
    most = entries.agg(F.max("total")).first()[0] or 0
    carried = kept
    while True:
        schema = "tree string, block long, total long, levels int, nodes binary" + "".join(f", {name} array<{kind}>" for name, kind in carried.items())

        dealt = entries.select("tree", F.call_function("div", F.col("idx"), F.lit(size).cast("long")).alias("block"), "idx", "digest", "total", *carried)
        blocks = materialise(dealt.groupBy("tree", "block").applyInArrow(_block_of(tuple(carried), full), schema))
        found.append(blocks)
        if most <= size:
            return found
        most = -(-most // size)
        entries = blocks.where(F.col("total") > size).select("tree", F.col("block").alias("idx"), _root().alias("digest"), F.ceil(F.col("total") / size).alias("total"))
        carried = {}


def _block_of(carried: tuple[str, ...], full: int) -> Callable[[pa.Table], pa.Table]:
    """From the leaves of one block to its row."""

    def built(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        total = group.column("total")[0].as_py()
        levels = full if total > leaves_in(full) else height_for(total)
        same = {c: [group.column(c)[0].as_py()] for c in ("tree", "block")}
        made = {"total": [total], "levels": pa.array([levels], pa.int32()), "nodes": [build_block(group.column("digest").to_pylist(), levels)]}
        return pa.table(same | made | {c: pa.array([group.column(c).to_pylist()], pa.list_(group.schema.field(c).type)) for c in carried})

    return built


def _root() -> Column:
    return F.substring(F.col("nodes"), 1, WIDTH)


def roots(stored: list[DataFrame], full: int = LEVELS) -> DataFrame:
    """(tree, tier, digest): where every tree ends, and in which tier."""
    ends = [blocks.where(F.col("total") <= leaves_in(full)).select("tree", F.lit(k).alias("tier"), _root().alias("digest")) for k, blocks in enumerate(stored)]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


PATH = "array<struct<before: string, after: string>>"


def handed(stored: list[DataFrame], above: DataFrame, full: int = LEVELS) -> list[DataFrame]:
    """For each tier (tree, block, path, subroot): the siblings from the root of every block on, nearest first.

    `above`: (tree, tier, path, subroot), the siblings above each tree's own end.
    """
    found: list[DataFrame] = [None] * len(stored)
    for k in range(len(stored) - 1, -1, -1):
        rows = above.where(F.col("tier") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if k + 1 < len(stored):
            rows = rows.unionByName(_children(stored[k + 1], found[k + 1], full))
        found[k] = rows
    return found


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: blocks are large, and only one of them is turned into Python values at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _children(blocks: DataFrame, paths: DataFrame, full: int) -> DataFrame:
    """(tree, block, path, subroot) of the leaves of blocks."""
    size = leaves_in(full)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            begin = row["block"] * size
            leaves = min(size, row["total"] - begin)
            steps = list(siblings(row["nodes"], row["levels"], leaves))
            paths = []
            for i in range(leaves):
                path, at = [], i
                for level in steps:
                    path.append({"before": level[at][0], "after": level[at][1]})
                    at //= RUN
                paths.append(path + row["path"])
            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            columns = [pa.array([row["tree"]] * leaves), pa.array(range(begin, begin + leaves), pa.int64()), pa.array(paths, kind), pa.array([row["subroot"]] * leaves, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "path", "subroot"])

    joined = blocks.join(paths, ["tree", "block"]).select("tree", "block", "total", "levels", "nodes", "path", "subroot")
    return joined.mapInArrow(split, f"tree string, block long, path {PATH}, subroot binary")


def leaf_of(fields: dict[str, Column]) -> Column:
    """H over the fields in order: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(docs: DataFrame, key: str = "source", text: Callable[[Column], Column] | None = None, full: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tiers of the trees of each `key`, and of the tree over them. The lowest blocks carry ids and, where `text` changes a row's text,
    the leaf that the row would have now."""
    fields = {c: F.col(c) for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("s"), F.col(key)), F.lit(""))
    now = text(F.col("text")) if text else F.col("text")
    changed = F.when(now.isNotNull() & (now != F.col("text")), leaf_of(fields | {"text": now}))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(fields).alias("digest"), changed.alias("changed"))
    stored = tiers(ranked(materialise(rows), "tree", "doc_id", "digest"), {"doc_id": "bigint", "changed": "binary"}, full)
    tops = roots(stored, full).select(F.lit("").alias("all"), F.col("tree").alias("of"), "tier", "digest")
    placed = ranked(tops, "all", "of").select(F.col("all").alias("tree"), "idx", "digest", "total", "of", "tier")
    return stored, tiers(placed, {"of": "string", "tier": "int"}, full)


def audited(docs: DataFrame, text: Callable[[Column], Column] | None = None, full: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified): digests as hex text.

    `proof` has the siblings' digests from leaf to root, one after the other; `folded_root` is what the leaf of the row as `text` leaves it
    folds to with them.
    """
    stored, top = manifest(docs, text=text, full=full)
    root = roots(top, full).select("digest").first()
    root = root[0].hex() if root else ""

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for row in _each(batches):
            leaves = len(row["of"])
            store = np.frombuffer(row["nodes"], np.uint8).reshape(-1, WIDTH)
            own = [x.tobytes() for x in store[address(row["levels"], row["levels"] - 1, np.arange(leaves))]]
            steps = list(siblings(row["nodes"], row["levels"], leaves))
            paths = [[{"before": level[i // RUN**k][0], "after": level[i // RUN**k][1]} for k, level in enumerate(steps)] + row["path"] for i in range(leaves)]
            yield pa.RecordBatch.from_arrays([pa.array(row["of"], pa.string()), pa.array(row["tier"], pa.int32()), pa.array(paths, kind), pa.array(own, pa.binary())], names=["tree", "tier", "path", "subroot"])

    start = roots(top, full).select("tree", "tier", F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"))
    joined = top[0].join(handed(top, start, full)[0].drop("subroot"), ["tree", "block"]).select("levels", "nodes", "of", "tier", "path")
    subtrees = materialise(joined.mapInArrow(above, f"tree string, tier int, path {PATH}, subroot binary"))
    paths = handed(stored, subtrees, full)[0]
    rows = stored[0].join(paths, ["tree", "block"]).select("levels", "nodes", "doc_id", "changed", "path", "subroot")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            leaves = len(row["doc_id"])
            store = np.frombuffer(row["nodes"], np.uint8).reshape(-1, WIDTH)
            own = [x.tobytes().hex() for x in store[address(row["levels"], row["levels"] - 1, np.arange(leaves))]]
            steps = list(siblings(row["nodes"], row["levels"], leaves))
            tail, memo = [(x["before"], x["after"]) for x in row["path"]], {}
            proofs, ends = [], []
            for i, now in enumerate(row["changed"]):
                path = [level[i // RUN**k] for k, level in enumerate(steps)] + tail
                current = own[i] if now is None else now.hex()
                for before, after in path:
                    run = before + current + after
                    if (known := memo.get(run)) is None:
                        known = memo[run] = hashlib.sha256(run.encode()).hexdigest()
                    current = known
                proofs.append("".join(x for pair in path for x in pair))
                ends.append(current)
            subroot = row["subroot"].hex()
            columns = [pa.array(row["doc_id"], pa.int64()), pa.array(own), pa.array([subroot] * leaves), pa.array(proofs, pa.string()), pa.array(ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "proof", "folded_root"])

    found = rows.mapInArrow(folded, "doc_id long, leaf string, subroot string, proof string, folded_root string")
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))
