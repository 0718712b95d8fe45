"""Streams that end in keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomstrand.sources.keyed import KeyedTable, Merge

#: Times that a batch is tried against writers that were first.
TRIES = 5


def merge_stream(stream: DataFrame, store: KeyedTable, merge: Merge, checkpoint: str, epoch: int) -> StreamingQuery:
    """Merge every micro-batch into the table; run on what is there, then stop.

    A batch that is run again after a failure changes nothing. Another writer's commit in between makes it merge again on top of that;
    a writer of a newer epoch stops the stream.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for _ in range(TRIES):
                outcome = store.commit(batch, merge, batch=number, epoch=epoch)
                if outcome == "fenced":
                    raise RuntimeError(f"epoch {epoch} has been taken over")
                if outcome != "conflict":
                    return
            raise RuntimeError(f"batch {number} lost to other writers {TRIES} times")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
