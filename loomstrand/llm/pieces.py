"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

A text is normalised by the model's own rule and falls into symbols, one for each character. An agenda holds every adjacent
pair of symbols that is a piece, best score first and leftmost among equals; the best pair is merged, the pairs that it
makes with its neighbours join the agenda, and pairs that lost a side are skipped. What is no piece at the end is written
as its bytes.

No merge ever crosses a place where the vocabulary has no piece with both neighbours inside: before a word mark that
follows another character, and round characters that stand in no longer piece. Texts are cut there, so that the agenda runs
over short segments, and a segment that was seen before is not merged again. A text without such places is one segment.

Every segment that is new to a worker is held against the sentencepiece library, all those of an Arrow batch in one call
(whole texts, where the model's normaliser changes line ends); `agrees` is false for texts with a segment that the library
encodes otherwise. Decoding is the library's.

A null text counts as empty, and an empty text is the end id alone. Rows are kept as they are, repeated ones as well;
columns called ids, decoded or agrees are replaced. An empty table stays empty.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomstrand.llm.common import slices

MARK = "▁"
#: Segments that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
#: Symbols up to which a scan of the agenda is cheaper than a heap; the rank of a pair that is no piece.
FEW, NEVER = 40, float("inf")
#: Segments that the library checks as one text.
TOGETHER = 50
ADDED = ("ids", "decoded", "agrees")


class Agenda:
    """Encoder of one vocabulary."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        if any(self.library.is_unused(i) for i in ids):
            raise ValueError("a vocabulary with unused pieces needs its merges undone, which is not done here")
        plain = [i for i in ids if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        names = {i: self.library.id_to_piece(i) for i in plain}
        self.id_of = {name: i for i, name in names.items()}
        self.order = {name: -self.library.get_score(i) for i, name in names.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(self.library.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no pieces for bytes")
        self.end = self.library.eos_id()
        longer = [name for name in names.values() if len(name) > 1]
        joined = set("".join(longer))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        parted = not any(re.search(f"[^{MARK}]{MARK}", name) for name in longer)
        self.segments = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]" if parted and alone else r"(?s).+").findall
        # Whether segments can be checked apart from their texts: line ends stay and stand alone.
        self.apart = parted and "\n" not in joined and self.library.normalize("\n") == f"{MARK}\n"
        self.known: dict[str, list[int]] = {}
        self.wrong: set[str] = set()

    def _by_heap(self, symbols: list[str]) -> list[str]:
        """Merged symbols; the agenda is a heap and the symbols are linked, so that n of them take n log n."""
        order, push, pop = self.order, heapq.heappush, heapq.heappop
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # Entries: rank, left symbol, right symbol, characters of both.
        agenda = [(order[p], i, i + 1, 2) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in order]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length = pop(agenda)
            first, second = symbols[left], symbols[right]
            if not first or not second or len(first) + len(second) != length:
                continue
            symbols[left] = piece = first + second
            symbols[right] = ""
            previous, following = before[left], after[right]
            after[left] = following
            if following >= 0:
                before[following] = left
                wider = piece + symbols[following]
                if wider in order:
                    push(agenda, (order[wider], left, following, len(wider)))
            if previous >= 0:
                wider = symbols[previous] + piece
                if wider in order:
                    push(agenda, (order[wider], previous, left, len(wider)))
        return [symbol for symbol in symbols if symbol]

    def _by_scan(self, symbols: list[str]) -> list[str]:
        """The same for a few symbols: the agenda is the list of the pairs' ranks in order of place."""
        rank_of = self.order.get
        agenda = [rank_of(p, NEVER) for p in map(str.__add__, symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] = piece = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank_of(piece + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank_of(symbols[i - 1] + piece, NEVER)
        return symbols

    def merged(self, segment: str) -> list[int]:
        """Ids of one segment."""
        symbols = (self._by_scan if len(segment) <= FEW else self._by_heap)(list(segment))
        ids: list[int] = []
        for symbol in symbols:
            found = self.id_of.get(symbol)
            ids += [found] if found is not None else [self.bytes[b] for b in symbol.encode()]
        return ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text with the end id, and whether the library agrees."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        rows, new, known = [], {}, self.known
        for text in texts:
            ids: list[int] = []
            row = self.segments(self.library.normalize(text)) if text else []
            for segment in row:
                if (found := known.get(segment)) is None:
                    found = known[segment] = new[segment] = self.merged(segment)
                ids += found
            ids.append(self.end)
            rows.append((ids, row))
        if self.apart:
            self._check(new)
        for segment in new:
            if len(segment) > LONGEST:
                del known[segment]
        found = [ids for ids, _ in rows]
        if not self.apart:
            return found, [a == b for a, b in zip(found, self.library.encode(texts, num_threads=1, add_eos=True), strict=True)]
        return found, [not self.wrong or self.wrong.isdisjoint(row) for _, row in rows]

    def _check(self, new: dict[str, list[int]]) -> None:
        """Put the segments that the library encodes otherwise into `wrong`."""
        line, lead = self.merged("\n"), self.merged(MARK) + self.merged("\n")
        pairs = list(new.items())
        groups = [pairs[i : i + TOGETHER] for i in range(0, len(pairs), TOGETHER)]
        given = self.library.encode(["\n" + "".join(s if s.startswith(MARK) else f"\n{s}" for s, _ in group) for group in groups], num_threads=1)
        for group, ids in zip(groups, given, strict=True):
            if ids != lead + [i for s, own in group for i in (own if s.startswith(MARK) else line + own)]:
                self.wrong.update(s for s, own in group if self.library.encode(f"\n{s}", num_threads=1) != lead + own)

@functools.lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    """The encoder of a worker, loaded once."""
    return Agenda(path)


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with ids (array<int>, end id last), decoded (the library's text of them) and agrees.

    `model`: where each executor finds the vocabulary file.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = agenda(model)
        for batch in slices(parts, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids, agrees = encoder.encode(texts)
            decoded = encoder.library.decode(ids, num_threads=1)
            columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *ADDED])

    return rows.mapInArrow(batches, schema)
