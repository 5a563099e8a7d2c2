"""Restartable backfills over files as they arrive, in micro-batches, and windows of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def backfill(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 64, fmt: str = "parquet") -> None:
    """Everything that's in source and not yet in target, some files a batch. A stopped run goes on where it ended, and a
    repeated batch takes the place of its first attempt, as each batch writes a folder of its own."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(source)

    def write(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", step: str | None = None) -> DataFrame:
    """Counts and sums by window and type, for batches and streams; late rows are waited for. Goes beyond what's asked of the engine."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
