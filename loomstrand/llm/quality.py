"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of each whole text are taken where it is read and kept in the shared folder, so texts are read once. Labelled
rows (at most `TRAIN_ROWS`, chosen by a hash of the id) are standardised and mapped to cosines of random projections,
which approximate a Gaussian kernel. Each task sums its part of the normal equations; Spark adds the parts, and the
driver solves one system of `FEATURES` + 1 unknowns. A fifth of the labelled rows is kept from the fit; on it the scores
are counted in bins, and pooling adjacent violators turns them into a rising curve of the share of label 1.

Null and empty texts have the statistics of an empty text. Rows of `labels` without label or id are ignored; if an id has
several labels, the larger counts. With no labelled row, or with one label alone, every score is that label's share (0.5
without any). Repeated rows are scored alike; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

FEATURES, WIDTH, RIDGE, SEED = 192, 1.0, 1e-3, 7
TRAIN_ROWS, TRAIN_TASKS, BINS = 60_000, 16, 2000
#: A document is kept from this score on.
KEPT_FROM = 0.3

CLASSES = 12


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each byte of UTF-8 text."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = (
            1 if c in "abcdefghijklmnopqrstuvwxyz" else 2 if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 3 if c in "0123456789"
            else 4 if c == " " else 5 if c in "\n\r" else 6 if c in ".,;:?'" else 7 if c == "!" else 8 if c in "|<>{}[]\\=_~^`"
            else 9 if c in "#$%&*@+/" else 10 if 0xC0 <= b else 11 if 0x80 <= b else 0
        )
    return out


def statistics(text: str) -> list[float]:
    """Numbers about a whole text, of which none is infinite."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(_classes()[raw], minlength=CLASSES)
    chars = max(1, len(raw) - int(counts[11]))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = set(words)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    shares = (counts / chars).tolist()
    return [
        np.log1p(len(raw)), np.log1p(len(words)), *shares[1:4], *shares[5:11], shares[0],
        len(kinds) / n, np.log1p(n / max(1, len(kinds))), float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / (1 + int(counts[6]))),
        counts[2] / max(1, int(counts[1] + counts[2])), (counts[7] + counts[8] + counts[9]) / n,
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id long, x array<float>) for every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float32()))], ["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(made, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Curve:
    """A rising curve through pooled shares of label 1."""

    def __init__(self, at: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> None:
        pools: list[list[float]] = []
        for x, k, n in zip(at.tolist(), ones.tolist(), rows.tolist(), strict=True):
            pools.append([x * n, k, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[0] / p[2] for p in pools])
        self.y = np.array([p[1] / p[2] for p in pools])

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y)


class Scorer:
    """The learned map from statistics to scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float = WIDTH) -> None:
        self.mean, self.scale = mean, scale
        draw = np.random.default_rng(SEED)
        self.turn = draw.normal(size=(len(mean), FEATURES)) / (width * np.sqrt(len(mean)))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve: Curve | None = None
        self.share = 0.5

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores."""
        return np.clip(self.lift(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        return np.full(len(x), self.share) if self.curve is None else np.clip(self.curve(self.raw(x)), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, learned_from: Column, limit: int = TRAIN_ROWS) -> Scorer:
    """Learn from rows of `stats` (doc_id, x) that have a label in `labels` (doc_id, label) and for which `learned_from` holds."""
    marked = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    marked = marked.where(learned_from)
    known = marked.agg(F.count("*").alias("n")).first()["n"]
    if known > limit:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(limit / known * (1 << 20)))
    rows = common.materialise(
        stats.join(marked, "doc_id").repartition(TRAIN_TASKS).select("x", "label", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("kept"))
    )

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                cells = np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), sum(batch.column("label").to_pylist())]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    def summed(df: DataFrame) -> np.ndarray:
        found = df.groupBy("cell").agg(F.sum("v").alias("v")).toPandas().sort_values("cell")
        return found["v"].to_numpy()

    sums = summed(rows.mapInArrow(moments, "cell long, v double"))
    if not len(sums):
        return Scorer(np.zeros(1), np.ones(1))
    width, n, ones = (len(sums) - 2) // 2, sums[-2], sums[-1]
    mean = sums[:width] / n
    scale = np.sqrt(np.maximum(sums[width : 2 * width] / n - mean**2, 1e-9))
    scorer = Scorer(mean, np.where(scale < 1e-4, 1.0, scale))
    scorer.share = float(ones / n)
    if ones in (0, n):
        return scorer

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = FEATURES + 1
        left, right = np.zeros((side, side)), np.zeros(side)
        for batch in batches:
            if batch.num_rows:
                phi, y = scorer.lift(_matrix(batch.column("x"))), batch.column("label").to_numpy().astype(np.float64)
                left += phi.T @ phi
                right += phi.T @ y
        cells = np.concatenate([left.ravel(), right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    cells = summed(rows.where("not kept").select("x", "label").mapInArrow(equations, "cell long, v double"))
    side = FEATURES + 1
    left, right = cells[: side * side].reshape(side, side), cells[side * side :]
    scorer.weights = np.linalg.solve(left + RIDGE * max(1.0, left[-1, -1]) * np.diag([1.0] * FEATURES + [1e-9]) / FEATURES + 1e-9 * np.eye(side), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.round(scorer.raw(_matrix(batch.column("x"))) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["at", "label"])

    curve = rows.where("kept").select("x", "label").mapInArrow(binned, "at long, label int")
    curve = curve.groupBy("at").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).toPandas().sort_values("at")
    if len(curve):
        scorer.curve = Curve(curve["at"].to_numpy() / BINS, curve["ones"].to_numpy(), curve["n"].to_numpy())
    return scorer


def quality_scores(docs: DataFrame, labels: DataFrame, learned_from: Column, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text); `labels` has (doc_id, label) and `learned_from` uses doc_id."""
    stats = common.materialise(text_statistics(docs))
    learned = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, learned_from, limit))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = learned.value.score(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return stats.mapInArrow(scored, "doc_id long, score double")


def kept(docs: DataFrame, labels: DataFrame, learned_from: Column, least: float = KEPT_FROM, limit: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` whose score is `least` or more; no text leaves its task."""
    marked = labels.where("label is not null and doc_id is not null").where(learned_from).select("doc_id").distinct()
    stats = text_statistics(docs).join(marked, "doc_id", "left_semi")
    learned = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, learned_from, limit))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], dtype=np.float32)
            yield batch.filter(pa.array(learned.value.score(found.astype(np.float64)) >= least))

    return docs.mapInArrow(chosen, docs.schema)
