"""Streams of vectors into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Index


def append_stream(stream: DataFrame, index: Index, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch to the index as one segment. A batch that comes again after a failure adds nothing: ids that the index has are left out, and of an id that a batch repeats one row goes in."""

    def one(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([index.m.id_col])
        known = index.present().selectExpr(f"id AS {index.m.id_col}")
        fresh = fresh.join(known, index.m.id_col, "left_anti")
        index.append(fresh)

    out = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
