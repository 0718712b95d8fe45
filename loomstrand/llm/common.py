"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 2 << 20
#: Short rows that a partition of what a round has written should hold, and up to how many of them a join broadcasts.
PART_ROWS, FEW_ROWS = 1 << 14, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where that is unset, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """`df`, about so many rows; joins broadcast it while they are `most`, or else FEW_ROWS, at most."""
    return F.broadcast(df) if rows <= (FEW_ROWS if most is None else most) else df


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """The short rows of `df`, written, in no more partitions than they fill, and how many there are.

    A round costs Spark one task for each partition of each of its shuffles, and a few kilobytes of files and log for each
    task: with many partitions and few rows that is more than the rows themselves.
    """
    written = materialise(df)
    rows = written.count()
    return written.coalesce(max(1, -(-rows // PART_ROWS))), rows


def let_go(spark: SparkSession) -> None:
    """Have the files of rounds that are over removed: Spark cleans up what the driver has collected as garbage, and small rounds
    alone bring no collection about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column`, or of one row where a row is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin = i
                held = 0
            held += size
        yield batch.slice(begin)


def fold_of(doc_id, folds: int = 5):
    """crc32 of the id written as text, modulo the number of folds; a null id is folded as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
