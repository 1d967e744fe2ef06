"""An append-only chunk log as a stream: the latest row of each chunk, kept as state and as a log of changes; and counts in time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import logs


def latest_changes(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key as a streaming aggregate: one row a key in the state store, however many tries it had."""
    rest = [c for c in log.columns if c not in keys]
    found = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return found.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def merged(log: DataFrame, keys: list[str], seq: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each batch's changed keys to out/batch=<id>. A batch that is tried again replaces its folder, so that a lost executor or driver repeats nothing."""

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = latest_changes(log, keys, seq).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(out: DataFrame, keys: list[str], seq: str, keep: Column | None = None) -> DataFrame:
    """The table that merged() has written so far, read as a batch: the latest row of each key, and of these those where keep holds."""
    return logs.latest_wins(out, keys, F.col(seq), keep)


def windowed_counts(log: DataFrame, time: str, status: Column, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, status, n) in tumbling windows; rows later than the watermark are left out. An extension: batch logs have no windows."""
    stamped = log.withColumn("status", status).withWatermark(time, late)
    found = stamped.groupBy(F.window(time, window), "status").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("window_start"), "status", "n")
