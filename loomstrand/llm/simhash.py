"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints are made where the texts are read; equal ones fall together before anything is compared. The others are dealt
out once for each of several masks and only meet those that agree on all of the mask's bits. That agreement is the top node
of an index: below it the fingerprints are sorted by the Gray rank of the word that the mask is in, runs of `FAN` become a
node that holds the bits on which they agree and its parent did not, and so on upwards. A search runs down all levels for
many fingerprints at once, adds up the differing bits node by node, and drops a whole group as soon as the sum passes the
distance, or if all of the group already is in the searcher's component. Each task gives back only a spanning forest of the
links it found, never all pairs.

* `simhash_groups` links 64-bit fingerprints that differ in at most `DISTANCE` bits. Its masks are choices of
  `bands - DISTANCE` of `bands` bands, on one of which such a pair agrees wholly (exact, by the pigeonhole principle).
* `similar_groups` links texts whose sets of word shingles have a Jaccard similarity of `SIMILARITY` or more. The index finds
  those whose fingerprints are near, and each such link is held against the sets themselves. An exact check follows for what
  fingerprints don't see: two such sets share one of their rarest shingles, whatever order "rarest" is (the prefix filter), so
  only sets that do can be candidates. Rounds try a spanning forest of the candidates between components, as long as half of
  it holds; then every candidate pair that this left in two components is tried. No link is made that wasn't verified.

Null and empty texts have fingerprint zero and link like others. Texts of fewer words than a shingle are one shingle.
Repeated rows and ids stay rows of the result; a component without any id has a null component. An empty table gives
no rows. Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common
from loomstrand.llm.components import components, spread_join

DISTANCE = 4
SHINGLE = 4
SEED = 42
SIMILARITY, SIMILAR_SHINGLE = 0.8, 5
#: Shingles are common whose bucket, of `1 << RANGE_BITS + 16` (by their first bits), is met in one of `COMMON` texts or more.
COMMON, RANGE_BITS = 2000, 10
#: Bits of a set's parity sketch, and pairs that a task holds before it gives them back.
SKETCH, HELD_PAIRS = 512, 1 << 20
#: Ids of texts that are fetched again are broadcast up to so many, and joined beyond.
FETCHED = 1_000_000
#: Buckets in which shingles are counted before single ones are.
BUCKETS = 1 << 14
#: Children of an index node, fingerprints that search at once, and rows that one search task should hold.
FAN, SEARCHERS, TASK_ROWS = 8, 4096, 250_000
#: Fingerprints that agree on one choice of bands should be so many at most; more bands are taken beyond.
CROWD = 256


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; A to Z count as lower case."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)] if words else [], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: 1 - shingle].tolist()
    return np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Words of a fingerprint: a bit is set if it is in over half of the hashes. Later words remix the hashes."""
    out = np.zeros(words, dtype=np.uint64)
    for k in range(words if len(hashes) else 0):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = hashes ^ (hashes >> np.uint64(32))
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[k] = np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> DataFrame:
    """(doc_id long, code binary) for every row: the words of its fingerprint."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            codes = []
            for text in batch.column("text").to_pylist():
                codes.append(majority(shingle_hashes(text or "", shingle, seed), words).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.binary())], ["doc_id", "code"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(made, "doc_id long, code binary")


def band_masks(count: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(word, mask as a signed number) of the choices of bands for so many fingerprints of one word."""
    bands = distance + 1
    while bands < distance + 3 and count > CROWD << (64 * (bands - distance) // bands):
        bands += 1
    edges = [64 * i // bands for i in range(bands + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = [reduce(int.__or__, some) for some in combinations(parts, bands - distance)]
    return [(0, m - (1 << 64) if m >> 63 else m) for m in chosen]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of 64-bit codes in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over fingerprints (rows of words) sorted by group and Gray rank: one tree for each group."""

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        self.codes = codes
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels: list[dict[str, np.ndarray]] = []
        owner = group
        begin, high, low = np.arange(len(codes)), codes, codes
        while True:
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(firsts, np.diff(np.r_[firsts, len(owner)]))
            heads = np.flatnonzero(place % FAN == 0)
            high, low = np.bitwise_or.reduceat(high, heads), np.bitwise_and.reduceat(low, heads)
            self.levels.append({"child": np.r_[heads, len(owner)], "begin": begin[heads], "pattern": low, "agreed": every ^ (high ^ low)})
            owner, begin = owner[heads], begin[heads]
            if len(heads) == len(firsts):
                break
        self.levels.reverse()
        self.levels[0]["own"] = self.levels[0]["agreed"]
        for level, above in zip(self.levels[1:], self.levels[:-1], strict=True):
            parent = np.repeat(np.arange(len(above["begin"])), np.diff(above["child"]))
            level["own"] = level["agreed"] & ~above["agreed"][parent]
        for level in self.levels:
            level["end"] = np.r_[level["begin"][1:], len(codes)]
        self.root = np.cumsum(np.r_[False, group[1:] != group[:-1]])

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a spanning forest of the pairs at `distance` or less."""
        label = np.arange(len(self.codes))
        forest: list[tuple[int, int]] = []
        at, step = 0, 64
        while at < len(self.codes):
            searchers = np.arange(at, min(len(self.codes), at + step))
            at += step
            step = min(SEARCHERS, step * 2)
            for a, b in zip(*self._search(searchers, label, distance), strict=True):
                x, y = self._top(label, a), self._top(label, b)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    forest.append((a, b))
            while (label[label] != label).any():
                label = label[label]
        found = np.array(forest, dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    @staticmethod
    def _top(label: np.ndarray, x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def _search(self, searchers: np.ndarray, label: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
        q, node = searchers, self.root[searchers]
        sums = np.zeros(len(q), dtype=np.int64)
        for level in self.levels:
            least, most = np.minimum.reduceat(label, level["begin"]), np.maximum.reduceat(label, level["begin"])
            kept = (level["end"][node] > q + 1) & ~((least[node] == most[node]) & (least[node] == label[q]))
            q, node, sums = q[kept], node[kept], sums[kept]
            sums = sums + np.bitwise_count((self.codes[q] ^ level["pattern"][node]) & level["own"][node]).sum(axis=1, dtype=np.int64)
            kept = sums <= distance
            q, node, sums = q[kept], node[kept], sums[kept]
            first, many = level["child"][node], level["child"][node + 1] - level["child"][node]
            q, sums = np.repeat(q, many), np.repeat(sums, many)
            node = np.repeat(first, many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
        kept = (node > q) & (label[node] != label[q])
        q, node = q[kept], node[kept]
        for k in range(self.codes.shape[1]):
            if k == 0:
                sums = np.zeros(len(q), dtype=np.int64)
            sums = sums + np.bitwise_count(self.codes[q, k] ^ self.codes[node, k])
            kept = sums <= distance
            q, node, sums = q[kept], node[kept], sums[kept]
        nearest_first = np.argsort(sums, kind="stable")
        return q[nearest_first].tolist(), node[nearest_first].tolist()


def _linked(batches: Iterator[pa.RecordBatch], masks: list[tuple[int, int]], distance: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    node, shared, choice, block = (rows.column(c).to_numpy() for c in ("node", "shared", "choice", "block"))
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
    word = np.array([k for k, _ in masks])[choice]
    rank = gray_rank(codes[np.arange(len(node)), word] ^ shared.view(np.uint64))
    order = np.lexsort((node, rank, block, shared, choice))
    key = np.stack([choice[order].astype(np.int64), shared[order], block[order]])
    group = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    node = node[order]
    a, b = GrayIndex(codes[order], group).links(distance)
    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def meeting(dealt: DataFrame, keys: list[str], rows: int, buckets: int = 0) -> DataFrame:
    """`dealt`, about so many rows, with a column block and partitioned so that every two rows of equal `keys` meet in a task under one block.

    `buckets`: where most keys are rare, only those are counted whose bucket of keys holds rows enough."""
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    block = min(TASK_ROWS, max(1024, rows // (2 * tasks)))
    counted = dealt
    if buckets:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
        full = dealt.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") > block).select("bucket")
        counted = dealt.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")
    #: At most rows / block of them.
    crowded = counted.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    pair = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.filter(met, lambda p: F.floor(p / F.col("blocks")) != p % F.col("blocks"))
    )
    return dealt.join(F.broadcast(crowded), keys, "left").select(*dealt.columns, F.explode(pair).alias("block")).repartition(tasks, *keys, "block")


def fingerprint_links(distinct: DataFrame, count: int, masks: list[tuple[int, int]], distance: int) -> DataFrame:
    """(a, b): links between nodes of `distinct` (node long, code binary), `count` rows, whose codes differ in `distance` bits at
    most and agree on one of the masks. They hold all such together that meet; no pair that they imply is named.

    What agrees on one mask beyond `block` rows is split into blocks, every two of which meet in a task.
    """
    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, mask = np.array([k for k, _ in masks]), np.array([m for _, m in masks], dtype=np.int64).view(np.uint64)
        for batch in batches:
            if n := batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint64).reshape(n, -1)
                shared = (codes[:, word] & mask).ravel().view(np.int64)
                again = pa.array(np.repeat(np.arange(n), len(masks)))
                choice = pa.array(np.tile(np.arange(len(masks), dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(again), batch.column("code").take(again), choice, pa.array(shared)], ["node", "code", "choice", "shared"])

    keyed = "node long, code binary, choice int, shared long"
    dealt = distinct.select("node", "code").mapInArrow(dealt_out, keyed)
    return meeting(dealt, ["choice", "shared"], count * len(masks)).mapInArrow(lambda batches: _linked(batches, masks, distance), "a long, b long")


def shingle_set(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """The node (a signed hash) of a text's set of shingles, and the sorted set."""
    from xxhash import xxh64_digest

    items = np.unique(shingle_hashes(text or "", shingle))
    return int.from_bytes(xxh64_digest(items.tobytes(), SEED), "big", signed=True), items


def bucket_of(items: np.ndarray) -> np.ndarray:
    """The buckets in which shingles are counted: their first bits."""
    return items >> np.uint64(48 - RANGE_BITS)


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets of shingles that many texts hold, and how often all texts together do. They only decide which shingles are rarest.

    Ranges of buckets are counted apart, and what moves is two bytes a shingle."""
    least = max(8, docs.count() // COMMON)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets = [shingle_set(t, shingle)[1] for t in batch.column("text").to_pylist()]
            buckets = np.sort(bucket_of(np.concatenate(sets)))
            parts, firsts = np.unique(buckets >> np.uint64(16), return_index=True)
            lows = [part.tobytes() for part in np.split((buckets & np.uint64(0xFFFF)).astype(np.uint16), firsts[1:])] if len(parts) else []
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(lows, pa.binary())], ["part", "lows"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, lows in zip(batch.column("part").to_pylist(), batch.column("lows").to_pylist(), strict=True):
                if part not in counts:
                    counts[part] = np.zeros(1 << 16, dtype=np.int64)
                np.add.at(counts[part], np.frombuffer(lows, dtype=np.uint16), 1)
        for part, own in counts.items():
            many = np.flatnonzero(own >= least)
            yield pa.RecordBatch.from_arrays([pa.array(many + (part << 16)), pa.array(own[many])], ["bucket", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(listed, "part int, lows binary").repartition("part").mapInArrow(added, "bucket long, n long").toPandas()
    buckets = found["bucket"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(buckets)
    return buckets[order], found["n"].to_numpy(dtype=np.int64)[order]


def rarest(items: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles in order of rarity, so many that two sets of this similarity or more share one of theirs."""
    most = len(items) - math.ceil(similarity * len(items) - 1e-9) + 1 if len(items) else 0
    if not len(known[0]):
        return items[:most]
    buckets = bucket_of(items)
    place = np.minimum(np.searchsorted(known[0], buckets), len(known[0]) - 1)
    return items[np.argsort(np.where(known[0][place] == buckets, known[1][place], 0), kind="stable")[:most]]


def sketch(items: np.ndarray, width: int = SKETCH) -> bytes:
    """Parities of how many items fall on each bit: two sets differ in at least as many items as their sketches in bits."""
    fallen = np.bincount((items >> np.uint64(20)).astype(np.int64) % width, minlength=width)
    return np.packbits((fallen & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_sketch(items: np.ndarray) -> bytes:
    """A sketch of four to eight bits an item, which rules out nearly all sets that differ in too many."""
    return sketch(items, max(SKETCH, 1 << (4 * len(items) - 1).bit_length() if len(items) else 0))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A wide sketch as one of `size` bytes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def shared_rarest(classes: DataFrame) -> DataFrame:
    """(node, size, place, token, block): the rarest shingles of every class that another one has too; equal (token, block) share a partition."""

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                heads = [np.frombuffer(h, dtype=np.int64) for h in batch.column("head").to_pylist()]
                many = np.array([len(h) for h in heads])
                again = pa.array(np.repeat(np.arange(len(heads)), many))
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(again), batch.column("size").take(again), pa.array(place.astype(np.int32)), pa.array(np.concatenate(heads))], ["node", "size", "place", "token"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            token, block = rows.column("token").to_numpy(), rows.column("block").to_numpy()
            order = np.lexsort((block, token))
            same = (token[order][1:] == token[order][:-1]) & (block[order][1:] == block[order][:-1])
            yield from rows.take(pa.array(order[np.r_[False, same] | np.r_[same, False]])).combine_chunks().to_batches(100_000)

    count = classes.agg(F.sum(F.octet_length("head") / 8)).first()[0] or 0
    dealt = classes.select("node", "size", "head").mapInArrow(dealt_out, "node long, size int, place int, token long")
    return common.materialise(meeting(dealt, ["token"], int(count), BUCKETS).mapInArrow(shared, "node long, size int, place int, token long, block long"))


def candidates(rows: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """(a, b, apart): pairs of rows of one partition, token and block that differ in root and may be this similar, with how many
    bits of their sketches differ. `forest`: in each task only pairs that those before them don't imply, if all of these hold.

    Pairs are met by distance in the order of sizes. What belongs to the most frequent root of its group looks for nothing, as
    the others look both ways: a group costs its rows times those outside that root.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        node, size, place, token, block = (table.column(c).to_numpy() for c in ("node", "size", "place", "token", "block"))
        order = np.lexsort((node, size, block, token))
        node, size, place, token, block = node[order], size[order].astype(np.int64), place[order], token[order], block[order]
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(node), -1)[order]
        names, own = np.unique(table.column("root").to_numpy()[order], return_inverse=True)
        label = np.arange(len(names))
        firsts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
        many = np.diff(np.r_[firsts, len(node)])
        group, begin, end = (np.repeat(v, many) for v in (np.arange(len(firsts)), firsts, firsts + many))
        found: list[np.ndarray] = []
        pairs = step = 0

        def outside() -> np.ndarray:
            """Whether a row's root isn't the most frequent one of its group."""
            values, counts = np.unique(group * len(names) + label[own], return_counts=True)
            first = np.lexsort((-counts, values // len(names)))
            first = first[np.r_[True, np.diff(values[first] // len(names)) > 0]]
            return (values[first] % len(names))[group] != label[own]

        def given() -> pa.RecordBatch:
            every = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(every[:, k]) for k in range(3)], ["a", "b", "apart"])

        while True:
            step += 1
            if step & (step - 1) == 0:
                out = outside()
                up = down = np.flatnonzero(out)
            up = up[up + step < end[up]]
            up = up[size[up] >= similarity * size[up + step] - 1e-9]
            down = down[down - step >= begin[down]]
            down = down[size[down - step] >= similarity * size[down] - 1e-9]
            if not len(up) and not len(down):
                break
            x = np.r_[up, down[~out[down - step]] - step]
            y = x + step
            both = size[x] + size[y]
            kept = (node[x] != node[y]) & (label[own[x]] != label[own[y]])
            kept &= np.minimum(size[x] - place[x], size[y] - place[y]) >= similarity / (1 + similarity) * both - 1e-9
            x, y, both = x[kept], y[kept], both[kept]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            kept = np.flatnonzero(apart <= (1 - similarity) / (1 + similarity) * both + 1e-9)
            if forest:
                kept = kept[np.argsort(apart[kept], kind="stable")]
                kept = kept[joining(label, own[x[kept]], own[y[kept]])]
            x, y, apart = node[x[kept]], node[y[kept]], apart[kept]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y), apart], axis=1))
            pairs += len(x)
            if pairs > HELD_PAIRS:
                yield given()
                found, pairs = [], 0
        if pairs:
            yield given()

    return rows.mapInArrow(paired, "a long, b long, apart long").distinct()


def joining(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links that join two trees of `label` when taken one after another; `label` then holds every node's root."""
    taken = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = GrayIndex._top(label, x), GrayIndex._top(label, y)
        if x != y:
            label[max(x, y)] = min(x, y)
            taken.append(k)
    while taken and (label[label] != label).any():
        label[:] = label[label]
    return np.array(taken, dtype=np.int64)


def listed(links: DataFrame, tries: int, classes: DataFrame, docs: DataFrame, shingle: int, wide: bool) -> DataFrame:
    """(node, size, items) of the nodes of `links` (a, b), so many: their sets, or the wide sketches of these, made from the texts again."""
    linked = common.few(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * tries, FETCHED)
    needed, count = common.gathered(classes.select("node", F.col("least_id").alias("doc_id")).join(linked, "node"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.join(common.few(needed.select("doc_id"), count, FETCHED), "doc_id", "left_semi").select("text")
    #: Classes without an id are looked for in all rows without one.
    if needed.where("doc_id is null").head(1):
        texts = texts.unionByName(rows.where("doc_id is null").select("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            #: Rows that repeat an id may differ in text, so the node is made from the text again.
            found = dict(shingle_set(t, shingle) for t in batch.column("text").to_pylist())
            items = [wide_sketch(i) if wide else i.tobytes() for i in found.values()]
            sizes = [len(i) for i in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(sizes, pa.int32()), pa.array(items, pa.binary())], ["node", "size", "items"])

    made = texts.mapInArrow(sets, "node long, size int, items binary")
    return common.materialise(made.join(common.few(needed.select("node"), count, FETCHED), "node", "left_semi").dropDuplicates(["node"]))


def _beside(links: DataFrame, items: DataFrame) -> DataFrame:
    """`links` with what `items` holds of a, as x, and of b, as y, and the sizes of both sets."""
    first, second = (items.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("items").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return links.join(first, "a").join(second, "b")


def sketched(links: DataFrame, items: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """The links (a, b) that the wide sketches don't rule out, with how many of their bits differ, and how many these are."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    size = min(len(x), len(y))
                    x, y = (folded(np.frombuffer(v, np.uint8), size).view(np.uint64) for v in (x, y))
                    apart.append(int(np.bitwise_count(x ^ y).sum()))
                both = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
                good = pa.array(np.array(apart) <= (1 - similarity) / (1 + similarity) * both + 1e-9)
                made = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart, pa.int64())], ["a", "b", "apart"])
                yield made.filter(good)

    return common.gathered(_beside(links.select("a", "b"), items).mapInArrow(compared, "a long, b long, apart long"))


def verified(links: DataFrame, items: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """The links (a, b, root_a, root_b) whose sets are this similar, and how many these are."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    good.append(both >= similarity * ((len(x) + len(y)) // 8 - both) - 1e-9)
                yield batch.select(["a", "b", "root_a", "root_b"]).filter(pa.array(good))

    ends = ["a", "b", "root_a", "root_b"]
    return common.gathered(_beside(links.select(*ends), items).mapInArrow(compared, ", ".join(f"{c} long" for c in ends)))


def _rooted(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """`links` with the roots of both ends, without those that a component holds already."""
    if roots is None:
        return links.withColumns({"root_a": F.col("a"), "root_b": F.col("b")})
    first, second = (roots.select(F.col("node").alias(n), F.col("root").alias(f"_{n}")) for n in ("a", "b"))
    rows = links.join(first, "a", "left").join(second, "b", "left")
    return rows.select(*links.columns, F.coalesce("_a", "a").alias("root_a"), F.coalesce("_b", "b").alias("root_b")).where("root_a <> root_b")


def joined_roots(links: DataFrame, items: DataFrame, similarity: float, roots: DataFrame | None, picks: int) -> tuple[DataFrame, int]:
    """(node, root) after the components of `roots` are joined by those of `links` (a, b, apart) that are verified, and how many were.

    In each of `picks` rounds every component tries its link of fewest differing bits only; what then still leads from one
    component to another is tried at once. So few sets move, and yet no link is lost.
    """
    right = 0
    for turn in range(picks + 1):
        links, left = common.gathered(_rooted(links, roots).select("a", "b", "apart", "root_a", "root_b"))
        if not left:
            break
        tried = links
        if turn < picks:
            ends = links.select("a", "b", F.struct("apart", "a", "b").alias("rank"), F.explode(F.array("root_a", "root_b")).alias("root"))
            tried = ends.groupBy("root").agg(F.min("rank").alias("best")).select("best.*").distinct()
            tried, left = common.gathered(tried.join(links.select("a", "b", "root_a", "root_b"), ["a", "b"]))
        good, now = verified(tried, items, similarity)
        right += now
        links = links.drop("root_a", "root_b").join(common.few(tried.select("a", "b"), left), ["a", "b"], "left_anti")
        common.let_go(links.sparkSession)
        if now:
            found = components(good, "root_a", "root_b")
            if roots is None:
                roots = found
            else:
                moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("_now")), "root", "left")
                fresh = found.join(roots.select("node"), "node", "left_anti")
                roots = common.few(*common.gathered(moved.select("node", F.coalesce("_now", "root").alias("root")).unionByName(fresh)))
    if roots is None:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots, right


def _named(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """`prints` with the component_id of each node. Crowded components and classes don't meet in one task."""
    rooted = common.materialise(classes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return spread_join(prints, spread_join(rooted, ids, "root").select("node", "component_id"), "node")


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text): links at `distance` bits or less."""
    written = F.lower(F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(F.hex("code"), i, F.lit(2))), ""))
    #: The 64 bits themselves, so that no two fingerprints share a node.
    node = F.conv(written, 16, -10).cast("long")
    prints = common.materialise(fingerprints(docs, shingle, seed).withColumn("node", node))
    classes = common.materialise(prints.groupBy("node", "code").agg(F.min("doc_id").alias("least_id")))
    count = classes.count()
    links = common.materialise(fingerprint_links(classes, count, band_masks(count, distance), distance).distinct())
    return _named(prints, classes, components(links)).select("doc_id", written.alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, component_id) for every row of `docs` (doc_id, text): links at this similarity or more, all of them."""
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(i) for _, i in found], pa.int32())]
            makers = (lambda i: majority(i).tobytes(), lambda i: rarest(i, known.value, similarity).tobytes(), sketch)
            columns += [pa.array([of(i) for _, i in found], pa.binary()) for of in makers]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "node", "size", "code", "head", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = common.materialise(texts.mapInArrow(made, "doc_id long, node long, size int, code binary, head binary, sketch binary"))
    #: No name holds on to a step whose rows are written: its files go when nothing knows them any more.
    classes = common.materialise(prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("size", "code", "head", "sketch")]))
    prints = common.materialise(prints.select("doc_id", "node"))
    common.let_go(docs.sparkSession)

    def merged(links: DataFrame, roots: DataFrame | None, picks: int) -> tuple[DataFrame, bool]:
        links, tries = common.gathered(links)
        common.let_go(docs.sparkSession)
        links, left = sketched(links, listed(links, tries, classes, docs, shingle, wide=True), similarity)
        common.let_go(docs.sparkSession)
        roots, right = joined_roots(links, listed(links, left, classes, docs, shingle, wide=False), similarity, roots, picks)
        common.let_go(docs.sparkSession)
        return roots, 0 < tries <= 2 * right

    count = classes.count()
    roots, _ = merged(fingerprint_links(classes, count, band_masks(count), DISTANCE).distinct(), None, 0)
    shared = shared_rarest(classes)
    common.let_go(docs.sparkSession)
    parts, forest = shared.rdd.getNumPartitions(), True
    while True:
        rooted = classes.select("node", "sketch").join(roots, "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("root"))
        apart = shared.join(rooted, "node").repartition(parts, "token", "block")
        #: What isn't a forest may name a pair of components many times, so each first tries its closest link.
        roots, more = merged(candidates(apart, similarity, forest), roots, 0 if forest else 1)
        if not forest:
            return _named(prints, classes, roots).select("doc_id", "component_id")
        forest = more
        common.let_go(docs.sparkSession)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without those of ids that aren't the least of their group; rows that repeat id and text stay once.

    Rows with a null id can't be named by a decision and stay.
    """
    groups = similar_groups(docs, similarity).where("doc_id is not null")
    kept = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n"))
    kept = common.materialise(kept)
    out = docs.join(kept.where("not kept").select("doc_id"), "doc_id", "left_anti")
    return out.dropDuplicates(["doc_id", "text"]) if kept.where("n > 1").head(1) else out
