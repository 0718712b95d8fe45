"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of every (language, hash) are summed by Spark over a sample of about `TRAIN_ROWS` labelled rows in all (chosen
by a hash of the id; all of them if there are fewer), turned into a matrix of log-probabilities, and broadcast: its size
is languages x `BUCKETS`. Languages share the sample equally: all rows of a rare one are in it, and what those leave over is
shared among the others. Whole texts are then scored in numpy, where they are read: as sparse rows of counts, a bounded number of
entries times the matrix at once, so that a very long text takes no more memory than others.

Null texts and texts without a letter are `und` with score 0. Without any labelled row everything is `und`. Rows whose
language is null are scored but never learned from. More than `MOST_LANGS` languages are refused. Repeated rows are scored alike; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
SMOOTHING = 0.5
TRAIN_ROWS, TRAIN_TASKS = 20_000, 32
#: Rows drawn of a language, if it has them, however many languages there are.
LEAST_ROWS = 50
#: Characters that are held as numbers at once, and numbers in one product of counts and matrix.
PART, ENTRIES = 1 << 18, 1 << 21
#: More values of lang than this are no languages; the matrix would grow with them.
MOST_LANGS = 2000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """For each code below U+10000 its lower-case letter, or a space if it is none."""
    out = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        if (x := chr(c)).isalpha():
            out[c] = ord(y) if len(y := x.lower()) == 1 and ord(y) < 0x10000 else c
    return out


def letters(text: str) -> np.ndarray:
    """Codes of a text's letters in lower case; a space for all that is none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wide = codes > 0xFFFF
    if not wide.any():
        return _lowered()[codes]
    strange = np.array([c if chr(c).isalpha() else 32 for c in codes[wide].tolist()], dtype=np.uint32)
    codes = _lowered()[np.where(wide, 32, codes)]
    codes[wide] = strange
    return codes


def gram_counts(text: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """How many character n-grams of the text's words fall into each bucket; all zero if it has no letter.

    A long text is taken `PART` characters at a time, so that no more than those are held as numbers.
    """
    counts = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    space = np.array([32], dtype=np.uint32)
    held, any_letter = np.empty(0, dtype=np.uint32), False
    for at in range(0, len(text) + PART, PART):
        part = letters(text[at : at + PART])
        any_letter = any_letter or bool((part != 32).any())
        codes = np.concatenate([held, *([space] if not at else []), part, *([space] if at + PART >= len(text) else [])])
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]] if len(codes) else codes
        rolled = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(codes) < n:
                break
            rolled = (rolled[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1 :]
            if n in sizes:
                found = (rolled[max(0, len(held) - n + 1) :] + np.uint32(n)) * np.uint32(0x9E3779B1) >> shift
                counts += np.bincount(found, minlength=buckets)
        held = codes[len(codes) - min(len(codes), max(sizes) - 1) :]
        if at + PART >= len(text):
            break
    return counts if any_letter else np.zeros(buckets, dtype=np.int64)


def log_sums(texts: list[str], matrix: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """Log-probability of each text with each language, up to a constant: (texts, languages); nan for texts without a letter.

    Texts become sparse rows of counts, which are multiplied with the matrix a bounded number of entries at once.
    """
    langs = matrix.shape[1]
    out = np.full((len(texts), langs), np.nan)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if held:
            column, weight = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            sizes = np.array([len(h[1]) for h in held])
            out[[h[0] for h in held]] = matrix[BUCKETS] + np.add.reduceat(matrix[column] * weight[:, None], np.cumsum(sizes) - sizes, axis=0)
            held.clear()

    size = 0
    for i, text in enumerate(texts):
        counts = gram_counts(text)
        column = np.flatnonzero(counts)
        if len(column):
            if held and (size + len(column)) * langs > entries:
                settle()
                size = 0
            held.append((i, column, counts[column].astype(np.float64)))
            size += len(column)
    settle()
    return out


def shares(counts: dict[str, int], limit: int) -> dict[str, float]:
    """The share of each language's rows that is drawn, for about `limit` rows in all and `LEAST_ROWS` or all of each language."""
    out, left = {}, limit
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        taken = min(counts[lang], max(LEAST_ROWS, left // (len(counts) - i)))
        out[lang], left = taken / counts[lang], left - taken
    return out


def learn(labelled: DataFrame, limit: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and log-probabilities (BUCKETS, languages) with the prior in a last row.

    `labelled`: rows of (key long, text, lang).
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    priors = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    langs, total = sorted(priors), sum(priors.values())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0))
    if total > limit:
        drawn = labelled.sparkSession.createDataFrame([(x, int(share * (1 << 30))) for x, share in shares(priors, limit).items()], "lang string, below long")
        labelled = labelled.join(F.broadcast(drawn), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.col("below"))
    place = {lang: i for i, lang in enumerate(langs)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for batch in common.slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                sums[place[lang]] += gram_counts(text or "")
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], ["lang", "bucket", "n"]
        )

    sums = np.zeros((BUCKETS, len(langs)))
    rows = labelled.select("text", "lang").repartition(TRAIN_TASKS).mapInArrow(counted, "lang int, bucket int, n long")
    for r in rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[r["bucket"], r["lang"]] = r["n"]
    logs = np.log((sums + SMOOTHING) / (sums.sum(axis=0) + SMOOTHING * BUCKETS))
    prior = np.log([priors[lang] / total for lang in langs])
    return langs, np.vstack([logs, prior])


def identify(docs: DataFrame, learned_from: Column | None = None, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs` (doc_id, text, lang), learning from rows where that holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows if learned_from is None else rows.where(learned_from)
    langs, matrix = learn(known.select(F.col("doc_id").alias("key"), "text", "lang"), limit)
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float64))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            names, scores = [], []
            for sums in log_sums([t or "" for t in batch.column("text").to_pylist()], shared.value) if langs else np.full((batch.num_rows, 1), np.nan):
                if np.isnan(sums[0]):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                likely = np.exp(sums - sums.max())
                best = int(likely.argmax())
                names.append(langs[best])
                scores.append(float(likely[best] / likely.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.select("doc_id", "text").mapInArrow(scored, "doc_id long, lang_pred string, score double")
