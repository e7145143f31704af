"""Streams into tables: each micro-batch becomes new immutable files, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, partition_by: list[str] | None = None, passphrase: str | None = None, **trigger) -> StreamingQuery:
    """Append a stream's micro-batches, each once: its number is in the manifest that publishes its rows, so neither is there without the other."""

    def put(batch: DataFrame, number: int) -> None:
        if not table.version():
            table.write(batch.limit(0), partition_by=partition_by, auto_snapshot=False)
        table.append(batch, passphrase=passphrase, stream=(checkpoint, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
