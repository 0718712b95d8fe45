"""Steps that change how rows are computed, not what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often later steps and filters name them.

    The optimiser writes the expression of a column out wherever it is named in a filter below or a projection above; the columns of
    an inlined list of one struct are left alone.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
