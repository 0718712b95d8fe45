"""Benchmark decontamination by BM25, a block-max inverted index of the test items, and overlap of question and answer.

The index holds the test items' words with BM25 impacts, each divided by the score that its item would get if it were the
passage, so that one threshold means the same share of every item. Every document is a row of overlapping passages, long
enough that each item lies whole in one of them, and every passage is a query: block-max WAND walks its words' posting
lists, skips all blocks whose largest impacts can't reach the threshold, and gives back all items at or above it, however
many. An exact bound spares most passages the walk: an item's commonest words, up to half of the threshold, are left out,
and unless the rest alone reach what is then missing the item can't get there.

What comes back is verified on the words around the passage: at least `OVERLAP` of the item's five-word shingles must be
there (or `ORDERED` of a short item's words in their order), and `PART` of the words of its question (all sentences but the last) and of its answer (the last).

Document frequencies and the mean length are those of all items, counted once in Spark, so results don't depend on batches.
Items are broadcast in batches of at most `BATCH_CHARS` characters, one pass over the documents for each. Words are runs of
letters, digits and underscores in lower case. Items without a word match nothing; items of fewer than five words are one
shingle. Null and empty texts hold nothing. Repeated items are found each; repeated documents give repeated rows, and null
ids stay null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved; shares that verification asks for.
RETRIEVED, OVERLAP, PART, SHINGLE = 0.6, 0.8, 0.6, 5
#: Items of so many words may instead have this share of their words in order: one changed word costs them over a fifth of their shingles.
SHORT, ORDERED = (7, 28), 0.85
BLOCK, BATCH_CHARS = 16, 8_000_000

FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, shingle_overlap double"

words_of = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer; one sentence alone is both."""
    sentences = [w for s in _SENTENCE.split(text.lower()) if (w := words_of(s))]
    if len(sentences) < 2:
        return (sentences[0], sentences[0]) if sentences else ([], [])
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """All runs of `size` words; fewer words are one run."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Postings:
    """Items of one word in order, with impacts, and the last item and largest impact of each block."""

    def __init__(self, items: list[int], impacts: list[float]) -> None:
        self.items, self.impacts = items, impacts
        self.most = max(impacts)
        self.block_last = [items[min(i + BLOCK, len(items)) - 1] for i in range(0, len(items), BLOCK)]
        self.block_most = [max(impacts[i : i + BLOCK]) for i in range(0, len(items), BLOCK)]


class Corpus(NamedTuple):
    """How many items there are, their mean length in words, and in how many items each word is."""

    total: int
    mean: float
    seen: Mapping[str, int]


class BlockMaxIndex:
    """BM25 over test items, searched by passages."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None) -> None:
        """`corpus`: the counts of all items, of which these may be a part; none means that these are all."""
        self.ids = [i for i, _ in items]
        self.words = [words_of(t.lower()) for _, t in items]
        self.parts = [parts_of(t) for _, t in items]
        self.shingles = [shingles(w) for w in self.words]
        self.longest = max(map(len, self.words), default=0)
        counts = [Counter(w) for w in self.words]
        known = corpus or Corpus(len(items), sum(map(len, self.words)) / max(1, sum(1 for w in self.words if w)), Counter(w for c in counts for w in c))
        total, mean, seen = known
        held: dict[str, tuple[list[int], list[float]]] = {}
        rows: list[list[tuple[float, str]]] = []
        for i, count in enumerate(counts):
            impacts = {
                w: math.log(1 + (total - seen[w] + 0.5) / (seen[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(self.words[i]) / mean))
                for w, n in count.items()
            }
            own = sum(impacts.values())
            rows.append(sorted((v / own, w) for w, v in impacts.items()))
            for w, v in impacts.items():
                held.setdefault(w, ([], []))[0].append(i)
                held[w][1].append(v / own)
        names = sorted(held)
        self.vocabulary = {w: k for k, w in enumerate(names)}
        self.lists = [Postings(*held[w]) for w in names]
        self.missing = np.zeros(len(items))
        telling: list[list[tuple[int, float]]] = [[] for _ in names]
        for i, row in enumerate(rows):
            left = 0.0
            for share, w in row:
                if left + share <= RETRIEVED / 2:
                    left += share
                else:
                    telling[self.vocabulary[w]].append((i, share))
            self.missing[i] = RETRIEVED - left - 1e-9
        sizes = np.array([len(t) for t in telling], dtype=np.int64)
        self.tell_size, self.tell_from = sizes, np.cumsum(sizes) - sizes
        self.tell_item = np.array([i for t in telling for i, _ in t], dtype=np.int64)
        self.tell_share = np.array([s for t in telling for _, s in t])

    def search(self, terms: list[int], threshold: float = RETRIEVED) -> list[tuple[int, float]]:
        """All items whose impacts for these distinct words add up to the threshold or more, by block-max WAND."""
        threshold -= 1e-9
        lists = [self.lists[t] for t in terms]
        at, block = [0] * len(lists), [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while live:
            live.sort(key=lambda c: lists[c].items[at[c]])
            bound, pivot = 0.0, -1
            for n, c in enumerate(live):
                bound += lists[c].most
                if bound >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            bound, upto = 0.0, None
            for c in live[: pivot + 1]:
                last = lists[c].block_last
                while block[c] < len(last) and last[block[c]] < item:
                    block[c] += 1
                if block[c] < len(last):
                    bound += lists[c].block_most[block[c]]
                    upto = last[block[c]] if upto is None else min(upto, last[block[c]])
            if bound < threshold:
                target = item + 1 if upto is None else upto + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                target = max(target, item + 1)
                moved = live[: pivot + 1]
            elif lists[live[0]].items[at[live[0]]] == item:
                score = sum(lists[c].impacts[at[c]] for c in live[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target, moved = item + 1, live[: pivot + 1]
            else:
                target, moved = item, [c for c in live[:pivot] if lists[c].items[at[c]] < item]
            for c in moved:
                items, i = lists[c].items, at[c]
                while i < len(items) and items[i] < target:
                    i += 1
                at[c] = i
            live = [c for c in live if at[c] < len(lists[c].items)]
        return found

    def passages(self, terms: np.ndarray) -> list[int]:
        """Of a document's word numbers (-1: none) the passages that pass the bound: passage p begins at p * longest, of twice that length."""
        places = np.flatnonzero(terms >= 0)
        sizes = self.tell_size[terms[places]]
        places, sizes = places[sizes > 0], sizes[sizes > 0]
        if not len(places):
            return []
        from_ = self.tell_from[terms[places]]
        entry = np.repeat(from_ - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        item, share = self.tell_item[entry], self.tell_share[entry]
        second = np.repeat(places // self.longest, sizes)
        key = np.concatenate([second, np.maximum(second - 1, 0)]) * len(self.ids) + np.concatenate([item, item])
        once = second > 0
        key = np.concatenate([key[: len(second)], key[len(second) :][once]])
        share = np.concatenate([share, share[once]])
        keys, where = np.unique(key, return_inverse=True)
        sums = np.bincount(where, share)
        return sorted(set((keys[sums >= self.missing[keys % len(self.ids)]] // len(self.ids)).tolist()))

    def verify(self, item: int, words: list[str]) -> tuple[float, float, float]:
        """Shares of the item's question words, answer words and shingles that these words hold."""
        near = Counter(words)
        question, answer = ((sum((Counter(part) & near).values()) / len(part)) if part else 0.0 for part in self.parts[item])
        wanted = self.shingles[item]
        size = min(SHINGLE, len(self.words[item]))
        there = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        return question, answer, len(wanted & there) / len(wanted)

    def in_order(self, item: int, words: list[str]) -> float:
        """Share of the item's words that stand in its order in some stretch of two words more than it has.

        A stretch begins where the item's first or second word is: a copy with one edit has one of them in its place.
        """
        wanted, most = self.words[item], 0
        n = len(wanted)
        for begin in (i for i, w in enumerate(words) if w in wanted[:2]):
            row = [0] * (n + 1)
            for word in words[begin : begin + n + 2]:
                left = 0
                for k, own in enumerate(wanted, 1):
                    above = row[k]
                    row[k] = left + 1 if word == own else max(above, row[k - 1])
                    left = above
            most = max(most, row[n])
        return most / n

    def holds(self, item: int, words: list[str], shared: float) -> bool:
        """Whether enough of the item is there: by shingles, or by order where few words make one edit cost too many shingles."""
        return shared >= OVERLAP or (SHORT[0] <= len(self.words[item]) <= SHORT[1] and self.in_order(item, words) >= ORDERED)

    def matches(self, text: str) -> dict[int, tuple[float, float, float, float]]:
        """For each item found in a text its best score, and what was verified there."""
        words = words_of(text.lower())
        get = self.vocabulary.get
        terms = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        best: dict[int, tuple[float, float, float, float]] = {}
        for p in self.passages(terms):
            begin = p * self.longest
            inside = terms[begin : begin + 2 * self.longest]
            for item, score in self.search(np.unique(inside[inside >= 0]).tolist()):
                slack = len(self.words[item])
                around = words[max(0, begin - slack) : begin + 2 * self.longest + slack]
                question, answer, shared = self.verify(item, around)
                if question >= PART and answer >= PART and self.holds(item, around, shared):
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0, 0.0)), (score, question, answer, shared))
        return best


def counted(items: DataFrame) -> tuple[DataFrame, int, float]:
    """Items with a word as (item_id, text, seen), how many there are, and their mean length; seen: in how many items each of its words is."""

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(rows, "text"):
            found = [words_of(t.lower()) for t in part.column("text").to_pylist()]
            columns = [part.column("item_id"), part.column("text"), pa.array([sorted(set(f)) for f in found], pa.list_(pa.string())), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "text", "words", "n"])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    spelled = known.mapInArrow(words, "item_id long, text string, words array<string>, n long").where("n > 0")
    rows = common.materialise(spelled.withColumn("key", F.md5(F.col("text").cast("binary"))))
    held = rows.select("key", F.explode("words").alias("word"))
    often = held.groupBy("word").agg(F.count("*").alias("seen"))
    seen = held.distinct().join(often, "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "seen"))).alias("seen"))
    total, mean = rows.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).head()
    return rows.join(seen, "key").select("item_id", "text", "seen"), total, mean


def _indexes(items: DataFrame) -> Iterator[Broadcast]:
    rows, total, mean = counted(items)
    context = items.sparkSession.sparkContext
    held: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    size = 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > BATCH_CHARS:
            yield context.broadcast(BlockMaxIndex(held, Corpus(total, mean, seen)))
            held, seen, size = [], {}, 0
        held.append((row["item_id"], row["text"]))
        seen.update(row["seen"])
        size += len(row["text"])
    if held:
        yield context.broadcast(BlockMaxIndex(held, Corpus(total, mean, seen)))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """FOUND: a row for each document of `docs` (doc_id, text) and each item of `items` (item_id, text) that it contains."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    out = docs.sparkSession.createDataFrame([], FOUND)
    for shared in _indexes(items):

        def found(rows: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part in common.slices(rows, "text"):
                made = [
                    (doc_id, index.ids[item], *figures)
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                    for item, figures in sorted(index.matches(text).items())
                ]
                if made:
                    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                    columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

        out = out.unionByName(texts.mapInArrow(found, FOUND))
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found; each row is decided by its own text, where it is read."""
    out = docs
    for shared in _indexes(items):

        def clean(rows: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for part in common.slices(rows, "text"):
                yield part.filter(pa.array([not shared.value.matches(t or "") for t in part.column("text").to_pylist()]))

        out = out.mapInArrow(clean, docs.schema)
    return out
