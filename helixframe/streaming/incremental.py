"""Spectra over a stream of site keys.

The stream is reduced to counts per (type, m, der), which is the whole state: its size is the number
of different keys, and any projection can be taken from it at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.project import spectrum_1d


def running_keys(keys: DataFrame) -> DataFrame:
    """Counts per key of a streaming frame (type, m_0, der_0, w)."""
    return keys.groupBy("type", "m_0", "der_0").agg(F.sum("w").alias("w"))


def windowed_keys(keys: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The same per event-time window; sites later than ``late`` are left out and closed windows leave the state."""
    return keys.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "type", "m_0", "der_0").agg(F.sum("w").alias("w"))


def spectrum_sink(keys: DataFrame, n: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write the spectrum so far after every batch; a batch that runs again overwrites its own result."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spectrum_1d(batch, n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return running_keys(keys).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()
