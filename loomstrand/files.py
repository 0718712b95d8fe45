"""Cutting of lineage for the loops that run on the driver."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows from files in the folder of spark.checkpoint.dir, which all executors share; a temporary one where that is unset."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
