"""Reports that follow a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def ingest(records: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Kernels and cube of each micro-batch, appended under its number: a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_snapshot(stream: DataFrame, group: str, value: str) -> DataFrame:
    """Rows and mean of each group so far (output mode ``complete``)."""
    return stream.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def stream_timeline(stream: DataFrame, ts: str, group: str, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Rows by day and group, with a watermark for late ones."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(group).alias("grp")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("bucket"), "grp", "n")
