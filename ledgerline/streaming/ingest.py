"""Keyed tables kept up to date by a stream: the batch operators on each micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.keyed_store import KeyedTable
from ledgerline.operators.lineage import lifecycle_states, merged_states


def upsert_stream(source: DataFrame, table: KeyedTable, order: Sequence[Column], checkpoint: str, keep: int = 2, **trigger) -> StreamingQuery:
    """Each micro-batch is a commit of ``table`` that rewrites the buckets it touches; the last ``keep`` commits stay readable.

    The batch's number is the commit's token, so that a batch that runs again after a failure counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, token=f"batch {number}")
        table.expire(keep)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lifecycle_stream(source: DataFrame, table: KeyedTable, checkpoint: str, keep: int = 2, **trigger) -> StreamingQuery:
    """Keeps the documents' states (``lifecycle_states``) up to date; late and repeated events find their place in the history."""

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(lifecycle_states(batch), merged_states, token=f"batch {number}")
        table.expire(keep)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
