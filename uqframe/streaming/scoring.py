"""Row-wise operators on a stream: the same functions, a streaming frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_scored(stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], path: str,
                 checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply row-wise steps (cleaning, features, physics, envelopes, scoring with fixed
    models) to a stream and append the result to Parquet. They keep no state."""
    out = stream
    for step in steps:
        out = out.transform(step)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
