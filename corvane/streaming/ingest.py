"""A stream of records into a collection, one batch insert per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.sources.catalog import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str):
    """Starts a query that inserts (id, vector, metadata); a batch that is replayed finds its ids live."""

    def insert(batch: DataFrame, _: int) -> None:
        collection.batch_insert(batch)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).start()
