"""Continuous indexing of arriving documents: an extension to batch imports.

Each micro-batch is one import into the library, which skips known ids and
contents, so a batch that is tried again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..library import Library


def index_stream(arrivals: DataFrame, library: Library, checkpoint: str, min_words: int = 1) -> StreamingQuery:
    """Start importing a stream of id, text and, if there, title, author, source."""

    def take(batch: DataFrame, _: int) -> None:
        library.import_books(batch, min_words, strict=False)

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
