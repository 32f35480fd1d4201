"""Rows that arrive as files: pooled with the same two sums as a batch, and appended window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweave.operators.pool import MetricSpec, partials


def pooled_stream(rows: DataFrame, spec: MetricSpec, keys: list[str], time: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Running (num, den) of a metric per window and keys; rows later than ``late`` are dropped by the watermark."""
    num, den = partials(spec)
    return rows.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))


def newest_runs(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Runs once each, whatever is sent again inside the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there now, and ends; progress is kept in ``checkpoint``."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
