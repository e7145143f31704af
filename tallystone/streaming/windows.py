"""Event-time windows of streams and tables: tumbling, sliding and session windows under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table
from .appends import append_stream


def windowed(df: DataFrame, at: str, size: str, measures: dict[str, Column], keys: list[str] | None = None, slide: str | None = None, session: bool = False, late: str = "1 hour") -> DataFrame:
    """window_start, window_end, ``keys`` and ``measures`` (aggregates by name) of each window of event time ``at``.

    Windows of ``size``, every ``slide`` if given; with ``session`` a window is a row of events with gaps of less than
    ``size``. On a stream, a window is final once an event more than ``late`` after its end has come; rows
    for windows that have been given out are dropped. On a table the result is exact, and the same as the stream's where no row came
    later than that. Rows without a time are in no window.
    """
    if session and slide:
        raise ValueError("session windows don't slide")
    frame = F.session_window(at, size) if session else F.window(at, size, slide) if slide else F.window(at, size)
    if set(measures) & {"window_start", "window_end", *(keys or [])}:
        raise ValueError("measures named like the result's own columns")
    grouped = df.where(F.col(at).isNotNull()).withWatermark(at, late).groupBy(frame.alias("__window"), *(keys or [])).agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *(keys or []), *measures)


def append_windows(stream: DataFrame, table: Table, checkpoint: str, at: str, size: str, measures: dict[str, Column], keys: list[str] | None = None, slide: str | None = None, session: bool = False, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Append each window to a table when it is final, once: state is in the checkpoint, a batch's number in the manifest."""
    return append_stream(windowed(stream, at, size, measures, keys, slide, session, late), table, checkpoint, **trigger)
