"""Incremental ingest and periodic export with Structured Streaming. A checkpoint remembers what has been read, so a file is
loaded once however often the loader runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, folder: str, checkpoint: str, target: str, read: Callable[[DataFrame], DataFrame], pattern: str = "*", once: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Text files that arrive in a folder, through a log reader, appended to a Parquet table. ``once``: all that is there, then
    stop; else look again at each interval."""
    lines = spark.readStream.option("pathGlobFilter", pattern).text(folder)
    out = read(lines).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()


def new_rows(spark: SparkSession, folder: str, schema, checkpoint: str, target: str, pattern: str, keys: Sequence[str] = ()) -> StreamingQuery:  # noqa: ANN001
    """Parquet files that arrive in a folder, appended; rows of one batch with equal ``keys`` count once."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def append(batch: DataFrame, number: int) -> None:
        (batch.dropDuplicates(list(keys)) if keys else batch).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def periodic_export(stream: DataFrame, export: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Runs an export for each batch that brought rows."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            export(batch, number)

    out = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def time_sessions(packets: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: sessions by a gap in event time, with a bound on late rows, which sessions by packet count lack."""
    return packets.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("packets")).select(key, "w.start", "w.end", "packets")


def windowed_bandwidth(packets: DataFrame, time: str, size: str, width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """An extension: the bandwidth of event-time windows with a bound on late rows."""
    return packets.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.sum(size).alias("total")).select("w.start", "total")
