"""Images that arrive as files: each is evaluated once, and its result carries the time at which it was captured.

A file and the event that tells its capture time come on streams of their own, in any order. Files are scored where they are read, so
that content goes through no shuffle and no state: what waits for the event is the result. Both sides drop what is delivered twice, within
the watermark, and meet on the file's name within an interval, which bounds their state. All of that state is in the checkpoint, so a
restart neither loses an image nor tells it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.samples import IMAGE_BYTES, capture_time_problem, iso_captured_at


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """New files under path as a stream (name, modified, length, content); content is read for those rows that are asked for it."""
    files = spark.readStream.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")


def scored_files(files: DataFrame, score: Callable[[DataFrame], DataFrame], limit: int = IMAGE_BYTES) -> DataFrame:
    """files with the columns that score adds for a usable size, null for others, and without content.

    The size is compared before content is read: the reader of files takes the filter, and the other branch has no content column.
    """
    usable = (F.col("length") > 0) & (F.col("length") <= limit)
    done = score(files.where(usable)).drop("content")
    rest = files.where(~usable).drop("content")
    return done.unionByName(rest, allowMissingColumns=True)


def image_events(files: DataFrame, captures: DataFrame, bindings: DataFrame, within_s: float = 600.0, delay_s: float = 600.0, limit: int = IMAGE_BYTES) -> DataFrame:
    """One row for each file of files (name, modified, length, results): binding, t, results, and reject, the reason of a refusal or null.

    captures (name, binding, captured_at text, received) must come within within_s of the file; bindings (binding, enabled) is a table. A
    file without any event comes out refused once the watermark, delay_s behind both streams, has passed the interval. t is the capture time, never the
    time of arrival, and without one nothing is told as a result.
    """
    results = [c for c in files.columns if c not in ("name", "modified", "length")]
    left = files.withWatermark("modified", f"{int(delay_s)} seconds").dropDuplicatesWithinWatermark(["name"])
    right = captures.select(F.col("name").alias("of"), "binding", "captured_at", "received").withWatermark("received", f"{int(delay_s)} seconds").dropDuplicatesWithinWatermark(["of"])
    span = F.expr(f"INTERVAL {int(within_s)} SECONDS")
    met = left.join(right, (F.col("name") == F.col("of")) & (F.col("received") >= F.col("modified") - span) & (F.col("received") <= F.col("modified") + span), "left_outer")
    known = bindings.select(F.col("binding").alias("bound"), "enabled")
    met = met.join(known, F.col("binding") == F.col("bound"), "left")
    reject = (
        F.when(F.col("of").isNull(), "no capture event")
        .when(F.col("bound").isNull(), "unknown binding")
        .when(~F.col("enabled"), "binding disabled")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > limit, "too large")
        .otherwise(capture_time_problem(F.col("captured_at")))
    )
    met = met.withColumn("reject", reject).withColumn("t", F.when(reject.isNull(), iso_captured_at(F.col("captured_at"))))
    return met.select("name", "binding", "modified", "length", "t", *[F.when(F.col("reject").isNull(), F.col(c)).alias(c) for c in results], "reject")
