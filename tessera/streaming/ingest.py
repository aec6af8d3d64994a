"""Continuous ingestion: a stream of document changes applied to an index in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..index import SearchIndex


def apply_changes(index: SearchIndex, batch: DataFrame) -> None:
    """One batch of (index_name, doc_id, content, op, seq): the last change of each document counts.

    Applying a batch again gives the same index, so a batch repeated after a failure does no harm."""
    last = batch.groupBy("index_name", "doc_id").agg(F.max_by(F.struct("content", "op", "seq"), "seq").alias("c")).select("index_name", "doc_id", "c.*")
    last = last.persist()
    removed = last.filter("op = 'delete'").select("index_name", "doc_id")
    written = last.filter("op <> 'delete'").select("index_name", "doc_id", "content", (F.col("op") != "stage").alias("indexed"), "seq")
    if not removed.isEmpty():
        index.remove_docs(removed)
    if not written.isEmpty():
        index.add_docs(written)
    index.compact()
    last.unpersist()


def ingest(index: SearchIndex, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start applying a stream of changes; ``once``: what is there now, then stop."""
    writer = changes.writeStream.foreachBatch(lambda batch, _: apply_changes(index, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
