"""Incremental ingest: new source files go through the dataset build batch by batch, and events through watermarked windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.dataset import Policy, build


def source_stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Source rows of JSON files as they arrive in a folder; a row's file and place in it give source_row its order within a batch."""
    rows = spark.readStream.schema(schemas.SOURCE_ROWS).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def ingest(stream: DataFrame, checkpoint: str, publish: Callable[[dict[str, DataFrame], int], None], policy: Policy = Policy()):
    """Build each batch and hand its artifacts to ``publish`` with the batch's number, under which a repeated batch must replace itself."""

    def batch(rows: DataFrame, number: int) -> None:
        numbered = rows.drop("source_file").withColumn("source_row", F.monotonically_increasing_id())
        kept: list[DataFrame] = []

        def settle(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        publish(build(numbered, policy, settle=settle).artifacts, number)
        for df in kept:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their values by type in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
