"""Incremental ingestion: a stream of documents becomes segments of an index, a flush a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loamdex.operators.index import Index


def write_segments(stream: DataFrame, index: Index, checkpoint: str, name: str = "stream", threshold: int | None = None):
    """Start a query that adds each batch's documents to the index, in segments of `threshold` documents (None: by their size).

    The manifest keeps the number of the last batch, so one that is tried again,
    or a restart from the checkpoint, adds nothing twice.
    """

    def flush(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            index.add(batch, threshold, stream=(name, number))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
