"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Every document is tokenised where it is read. Its pieces (id, place, length and checksum, never the ids) are dealt
by a hash into groups of about `GROUP_PIECES`, and each group is packed by itself: pieces in order of falling length
go where the squared counts of open sequences per residual gap become smallest; then the emptiest sequences are
dissolved and their pieces placed anew by the same rule, for a few rounds. Pieces of full length need no group.

Null texts count as empty; an empty text is the closing id alone. Repeated rows are packed as often as they come; rows
with a null id are packed like others. An empty table gives no rows. Other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces that one task packs. More lessen the waste, which is a few sequences a group.
GROUP_PIECES = 16_384
#: Rounds of dissolving, and the share of sequences that a round may dissolve at most.
ROUNDS, SHARE = 6, 4
#: Entries that a worker keeps at most in each of two generations of words, and of parts of words, that it has tokenised.
CACHE = 120_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file of `tokenizers`, without special tokens around them.

    Its pre-tokeniser never joins what white space parts, so the ids of a text are those of its words in turn, and
    words that came before come from a cache. Words of Latin-1 letters, digits and signs are split and merged by the
    file's model alone; all others go through the whole tokeniser.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]*").fullmatch
        self.words: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.older_cores: dict[str, bytes] = {}
        self.visible = self._visible()

    @staticmethod
    def _visible() -> dict[int, str]:
        """Latin-1 characters as the visible stand-ins of their UTF-8 bytes, as byte-level BPE files write them."""
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stand = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in kept)}
        return {c: "".join(stand[b] for b in chr(c).encode()) for c in range(256)}

    def _core(self, part: str) -> bytes:
        ids = self.older_cores.get(part)
        if ids is None:
            ids = array("I", [x.id for x in self.model.tokenize(part.translate(self.visible))]).tobytes()
        self.cores[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.older_words.get(word)
        if ids is not None:
            return ids
        cores = self.cores
        if word.isalpha() and max(word) <= "\xff":
            part = word.lower()
            return cores[part] if part in cores else self._core(part)
        if "<|" in word or not self.plain(word):
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([cores[p] if p in cores else self._core(p) for p in self.parts(word.lower())])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        found = text.replace("\n", " ").split(" ")
        if len(self.words) > CACHE:
            self.older_words, self.words = self.words, {"": b""}
        if len(self.cores) > CACHE:
            self.older_cores, self.cores = self.cores, {}
        words = self.words
        for w in set(found).difference(words):
            words[w] = self._word(w)
        return b"".join([words[w] for w in found])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker and file."""
    return WordTokenizer(path)


def pieces_of(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES for rows of (doc_id, text)."""
    ids_of = tokenizer(tokenizer_path).ids
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
    for batch in common.slices(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = ids_of(text or "") + closing
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )


class Packer:
    """Open sequences by residual gap, and the sum-of-squares rule."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.held: list[list[int]] = []
        self.gap: list[int] = []

    def add(self, items: list[int], gap: int) -> int:
        """A sequence with these items and this much room left."""
        self.held.append(items)
        self.gap.append(gap)
        if gap:
            self.count[gap] += 1
            self.by_gap[gap].append(len(self.held) - 1)
        return len(self.held) - 1

    def place(self, item: int, size: int) -> None:
        """Put an item where the sum of the squared counts grows least; ties go to the smallest gap that stays."""
        room = self.capacity - size
        if room > 0:
            here = self.count[size : self.capacity]
            grown = np.where(here > 0, 2 * (self.count[:room] - here) + 2, np.iinfo(np.int64).max)
            if here[0]:
                grown[0] = 1 - 2 * here[0]
            k = int(grown.argmin())
            if here[k] > 0 and grown[k] <= 2 * self.count[room] + 1:
                b = self.by_gap[size + k].pop()
                self.count[size + k] -= 1
                self.held[b].append(item)
                self.gap[b] = k
                if k:
                    self.count[k] += 1
                    self.by_gap[k].append(b)
                return
        self.add([item], room)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of `sizes` by sequence."""
    packer = Packer(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        packer.place(i, sizes[i])
    least = -(-sum(sizes) // capacity)
    for round_ in range(1, ROUNDS + 1):
        if len(packer.held) <= least:
            break
        many = round_ * min(len(packer.held) - least + 30, max(2, len(packer.held) // SHARE))
        order = sorted(range(len(packer.held)), key=lambda b: (-packer.gap[b], b))
        again = Packer(capacity)
        for b in order[many:]:
            again.add(list(packer.held[b]), packer.gap[b])
        for i in sorted((i for b in order[:many] for i in packer.held[b]), key=lambda i: (-sizes[i], i)):
            again.place(i, sizes[i])
        if len(again.held) <= len(packer.held):
            packer = again
    return packer.held


def _packed(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def placed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = group["length"].tolist()
        sequence = np.zeros(len(sizes), dtype=np.int64)
        offset = np.zeros(len(sizes), dtype=np.int64)
        base = int(group["bucket"].iloc[0]) << 32
        for b, items in enumerate(pack(sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + b, at
                at += sizes[i]
        return group.drop(columns="bucket").assign(sequence_id=sequence, offset=offset)

    return placed


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every row of `docs` (doc_id, text), with sequence_id and offset.

    Sequences hold at most `capacity` ids, gapless from offset 0. Only longer documents are cut.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = common.materialise(texts.mapInArrow(lambda batches: pieces_of(batches, tokenizer_path, capacity), PIECES))
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP_PIECES))
    packed = (
        short.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
        .groupBy("bucket")
        .applyInPandas(_packed(capacity), f"{PIECES}, sequence_id long, offset long")
    )
    full = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(full)
