"""Appending micro-batches to a stored corpus; an addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.corpus import Corpus


def append_stream(rows: DataFrame, path: str, checkpoint: str, half: bool = False, vector_col: str = "v") -> StreamingQuery:
    """Append every micro-batch of a streaming frame to the corpus at path, each once.

    The newest version is read anew for each batch.  Its manifest holds the last
    batch of every stream, known by its checkpoint, so a replayed batch is not
    appended again.  Another writer's version in between raises Conflict, and
    the restarted stream repeats the batch upon that version.
    """

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Corpus.load(batch.sparkSession, path).append(batch, half, vector_col=vector_col, batch=(checkpoint, number))

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
