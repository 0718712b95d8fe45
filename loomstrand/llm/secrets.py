"""Secret scanning by patterns, and by probabilistic automata inferred from the credentials that they find.

Three patterns give the base spans, which label credentials by kind. All distinct ones are learned from: Spark counts which
character class follows which (place, class before), the last place standing for all beyond `LONGEST`. These counts are an
automaton of bounded size however many credentials there are; its states are merged in the red-blue order as long as Hoeffding's
bound calls their futures compatible, and the frequencies left on the merged states make a probabilistic automaton (ALERGIA). Every
token of `LEAST` characters or more that is no part of a base span is a candidate, whatever its classes; one that only overlaps
a base span is scored as a whole. Its probability under each automaton, that of ending there included, is held against that
under a bigram model of the corpus's tokens outside of base spans. A kind's threshold is the log-ratio that at most the share
`ERROR` of all distinct such tokens without digits reach, and at least `MARGIN`: tokens with digits would
let unlabelled credentials raise their own threshold. The patterns' spans always stay.

Null and empty texts have no spans. Repeated rows are scanned alike. Without spans to learn from only patterns count. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

REMEMBERED = 20_000
ALPHA, LEAST, MARGIN, ERROR = 0.05, 12, 7.0, 0.001
#: Places of a credential that are told apart, credentials that a kind must have, bins of scores, and scores that the driver may hold.
LONGEST, FEWEST, BINS, HELD_SCORES = 64, 20, 1_000, 10_000

KINDS = ("assign", "access", "hex")
# The patterns of the base spans, and the least length of what each must hold.
PATTERNS = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
INFERRED = "inferred"
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind."""
    found = []
    for kind in KINDS:
        pattern, group, least = PATTERNS[kind]
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), m.end(), kind, m[group]))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> str:
    """One character for the class of each: digits, letters of hexadecimal numbers and others by case, signs as they are."""
    return token.translate(_SHAPE)


_SHAPE = {ord(c): "0" for c in "0123456789"} | {ord(c): "a" for c in "abcdef"} | {ord(c): "g" for c in "ghijklmnopqrstuvwxyz"}
_SHAPE |= {ord(c): "A" for c in "ABCDEF"} | {ord(c): "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}
#: Eleven classes and the end.
CLASSES, START, END = 12, "^", "$"


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, touched) of every token without the full stops around it; parts of a base span are none."""
    at, inside = 0, 0
    for m in _TOKEN.finditer(text):
        token = m[0].strip(".")
        start = m.start() + len(m[0]) - len(m[0].lstrip("."))
        end = start + len(token)
        while at < len(base) and base[at][0] <= start:
            inside = max(inside, base[at][1])
            at += 1
        if len(token) >= LEAST and end > inside:
            yield start, end, inside > start or (at < len(base) and base[at][0] < end)


def tally(strings: Iterable[str]) -> Counter[tuple[int, str, str]]:
    """How often a class (or the end) follows each (place, class before)."""
    return Counter((min(at, LONGEST), before, sign) for s in strings for at, (before, sign) in enumerate(zip(START + s, s + END, strict=True)))


class Automaton:
    """A deterministic probabilistic automaton inferred from strings, or from their tally."""

    def __init__(self, strings: Iterable[str] | dict[tuple[int, str, str], int], alpha: float = ALPHA) -> None:
        edges = strings if isinstance(strings, dict) else tally(strings)
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        states = {(0, START): 0}
        for at, before, sign in sorted(edges):
            states.setdefault((at, before), len(states))
        self.next: list[dict[str, int]] = [{} for _ in states]
        self.passed: list[dict[str, int]] = [{} for _ in states]
        self.ended = [0] * len(states)
        for (at, before, sign), n in sorted(edges.items()):
            state = states[at, before]
            if sign == END:
                self.ended[state] = n
            else:
                self.passed[state][sign] = n
                self.next[state][sign] = states[min(at + 1, LONGEST), sign]
        self.same = list(range(len(states)))
        self.totals = [e + sum(p.values()) for e, p in zip(self.ended, self.passed, strict=True)]
        self._merge()

    def _now(self, state: int) -> int:
        """What a state has been merged into."""
        while self.same[state] != state:
            self.same[state] = self.same[self.same[state]]
            state = self.same[state]
        return state

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.slack * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        pairs, seen = [(red, blue)], set()
        while pairs:
            x, y = pairs.pop()
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            n, m = self.totals[x], self.totals[y]
            if not n or not m:
                continue
            if self._differ(self.ended[x], n, self.ended[y], m):
                return False
            for c in self.passed[x].keys() | self.passed[y].keys():
                if self._differ(self.passed[x].get(c, 0), n, self.passed[y].get(c, 0), m):
                    return False
                if c in self.next[x] and c in self.next[y]:
                    pairs.append((self._now(self.next[x][c]), self._now(self.next[y][c])))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Merge two states, and whatever the same signs lead to from both."""
        pairs = [(red, blue)]
        while pairs:
            x, y = map(self._now, pairs.pop())
            if x == y:
                continue
            self.same[y] = x
            self.ended[x] += self.ended[y]
            self.totals[x] += self.totals[y]
            for c, n in self.passed[y].items():
                self.passed[x][c] = self.passed[x].get(c, 0) + n
                if c in self.next[x]:
                    pairs.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = next((s for r in red for _, s in sorted(self.next[r].items()) if self._now(s) not in known), None)
            if blue is None:
                break
            state = self._now(blue)
            for r in red:
                if self._compatible(r, state):
                    self._fold(r, state)
                    red = list(dict.fromkeys(map(self._now, red)))
                    break
            else:
                red.append(state)
        self.states = len(red)
        self.next = [{c: self._now(s) for c, s in own.items()} for own in self.next]
        self.start = self._now(0)

    def likelihood(self, string: str) -> float:
        """Log-probability of a string and of its end, smoothed by a tenth of a sight of every class in every state."""
        state, total = self.start, 0.0
        for c in string + END:
            n = self.totals[state] if state >= 0 else 0
            seen = (self.ended[state] if c == END else self.passed[state].get(c, 0)) if state >= 0 else 0
            total += math.log((seen + 0.1) / (n + 0.1 * CLASSES))
            state = self.next[state].get(c, -1) if state >= 0 else -1
        return total


class Bigrams:
    """A smoothed bigram model of ordinary tokens' shapes."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.pairs = counts
        self.first: dict[str, int] = {}
        for pair, n in counts.items():
            self.first[pair[0]] = self.first.get(pair[0], 0) + n

    def likelihood(self, string: str) -> float:
        """Log-probability of a string and of its end."""
        pairs = zip(START + string, string + END, strict=True)
        return sum(math.log((self.pairs.get(a + b, 0) + 1) / (self.first.get(a, 0) + CLASSES)) for a, b in pairs)


class Scorer:
    """Which tokens look like credentials."""

    def __init__(self, labelled: dict[str, list[str] | dict[tuple[int, str, str], int]], pairs: dict[str, int]) -> None:
        self.ordinary = Bigrams(pairs)
        tallies = {kind: given if isinstance(given, dict) else tally(given) for kind, given in labelled.items()}
        self.automata = {kind: Automaton(edges) for kind, edges in tallies.items() if sum(n for (at, _, _), n in edges.items() if at == 0) >= FEWEST}
        self.threshold = dict.fromkeys(self.automata, MARGIN)
        self.known: dict[str, bool] = {}

    def ratio(self, kind: str, string: str) -> float:
        """How much likelier a shape is under the automaton of a kind than among ordinary tokens, as a logarithm."""
        return self.automata[kind].likelihood(string) - self.ordinary.likelihood(string)

    def likely(self, token: str) -> bool:
        """Whether any automaton finds the token likelier than ordinary ones by its threshold."""
        string = shape(token)
        found = self.known.get(string)
        if found is None:
            found = any(self.ratio(kind, string) >= self.threshold[kind] for kind in self.automata)
            if len(string) <= LONGEST and len(self.known) < REMEMBERED:
                self.known[string] = found
        return found


def all_spans(text: str, scorer: Scorer | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans; one that the automata add may cover or overlap one of the base."""
    base = [s[:3] for s in base_spans(text)]
    if scorer is None or not scorer.automata:
        return base, base
    added = [(start, end, INFERRED) for start, end, _ in candidates(text, base) if scorer.likely(text[start:end])]
    order = (*KINDS, INFERRED)
    return base, sorted(base + added, key=lambda s: (s[0], order.index(s[2])))


#: Ranks are below this.
RANKS = 1 << 56


def _rank(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def reached(scores: DataFrame, above: int) -> float:
    """The score of `scores` (score, n) that exactly so many of the n rows of each come before, from the highest down.

    Histograms narrow it down, so that the driver holds few scores however many there are."""
    scores = scores.groupBy("score").agg(F.sum("n").alias("n"))
    while True:
        low, high, many = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
        small = many <= HELD_SCORES
        place = F.col("score") if small or low == high else F.floor((F.col("score") - low) / (high - low) * BINS)
        found = scores.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).collect()
        for row in sorted(found, reverse=True):
            if above < row.n:
                break
            above -= row.n
        if small or low == high:
            return row.place
        scores = scores.where(place == row.place)


def learn(docs: DataFrame) -> Scorer:
    """Automata of each kind from all distinct base spans, the bigrams of ordinary tokens, and thresholds from all distinct ones of them."""
    rows_of = ["kind", "string", "rank"]
    kept = dict(zip(rows_of, (pa.string(), pa.string(), pa.int64()), strict=True))

    def batch_of(columns: dict[str, pa.DataType], rows: Iterable[tuple]) -> pa.RecordBatch:
        values = list(zip(*rows, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)], list(columns))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter[str] = Counter()
        for batch in common.slices(batches, "text"):
            found = set()
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                found.update((kind, shape(credential), _rank(credential)) for _, _, kind, credential in base)
                for start, end, touched in candidates(text or "", [s[:3] for s in base]):
                    if touched:
                        continue
                    string = shape(text[start:end])
                    pairs.update(map("".join, zip(START + string, string + END, strict=True)))
                    if "0" not in string:
                        found.add(("ordinary", string, _rank(text[start:end])))
            yield batch_of(kept, found)
        yield batch_of(kept, (("pair", p, n) for p, n in pairs.items()))

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: Counter[tuple[str, int, str, str]] = Counter()
        for batch in batches:
            for kind, string in zip(batch.column("kind").to_pylist(), batch.column("string").to_pylist(), strict=True):
                edges.update((kind, *edge) for edge in tally([string]))
        columns = {"kind": pa.string(), "place": pa.int32(), "before": pa.string(), "sign": pa.string(), "n": pa.int64()}
        yield batch_of(columns, ((*edge, n) for edge, n in edges.items()))

    rows = common.materialise(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(gathered, "kind string, string string, rank long"))
    distinct = rows.where("kind <> 'pair'").distinct()
    edges = distinct.where("kind <> 'ordinary'").select("kind", "string").mapInArrow(tallied, "kind string, place int, before string, sign string, n long")
    edges = edges.groupBy("kind", "place", "before", "sign").agg(F.sum("n").alias("n")).collect()
    pairs = rows.where("kind = 'pair'").groupBy("string").agg(F.sum("rank").alias("n")).collect()
    scorer = Scorer({kind: {(e.place, e.before, e.sign): e.n for e in edges if e.kind == kind} for kind in KINDS}, {r["string"]: r["n"] for r in pairs})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = list(zip(batch.column("string").to_pylist(), batch.column("n").to_pylist(), strict=True))
            yield batch_of({"kind": pa.string(), "score": pa.float64(), "n": pa.int64()}, [(kind, shared.value.ratio(kind, s), n) for kind in shared.value.automata for s, n in shapes])

    ordinary = common.materialise(distinct.where("kind = 'ordinary'").groupBy("string").agg(F.count("*").alias("n")))
    total = ordinary.agg(F.sum("n")).first()[0]
    if scorer.automata and total:
        shared = docs.sparkSession.sparkContext.broadcast(scorer)
        scores = common.materialise(ordinary.mapInArrow(scored, "kind string, score double, n long"))
        for kind in scorer.automata:
            score = reached(scores.where(F.col("kind") == kind).select("score", "n"), int(ERROR * total))
            scorer.threshold[kind] = max(MARGIN, math.nextafter(score, math.inf))
    return scorer


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of `docs` (doc_id, text); both lists are arrays of (kind, begin, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    span = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [{"kind": k, "begin": a, "end": b} for a, b, k in spans]
        for batch in common.slices(batches, "text"):
            found = [all_spans(t or "", shared.value) for t in batch.column("text").to_pylist()]
            columns = [pa.array([rows(f[i]) for f in found], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, begin: int, end: int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of `text` replaced by the mark; spans that touch one another get one mark."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def cleaned(text: str | None) -> str | None:
        spans = all_spans(text, shared.value)[1] if text else []
        parts, at = [], 0
        for start, end, _ in spans:
            if start > at or not parts:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if spans else text

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([cleaned(t) for t in batch.column("text").to_pylist()], pa.string()))

    return docs.mapInArrow(made, docs.schema)
