"""Incremental runs: depth maps that arrive as files join what is known, image by image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import depth

PIXELS = "image_id long, r long, c long, depth double, conf double"


def new_depth_maps(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of pixels from Parquet files as they arrive."""
    return spark.readStream.schema(PIXELS).parquet(folder)


def merge_stream(pixels: DataFrame, cameras: DataFrame, out: str, checkpoint: str, least_confidence: float = 0.0):
    """Back-projects confident pixels and appends their points; the checkpoint makes a file count once over restarts."""
    points = depth.back_projected(depth.confident(pixels, least_confidence), cameras)
    return points.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_images(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images without pixels yet: what a resumed run has left to do."""
    return images.join(done.select("image_id").distinct(), "image_id", "left_anti")


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) per window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
