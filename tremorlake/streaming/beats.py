"""Windows over streams of samples: finished beats, late values, revisable ones, vision events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.quality import trusted
from ..operators.frames import good_value


UNKNOWN_STRUCT = -1035


def selected(rows: DataFrame, points: DataFrame, structs: DataFrame | None = None) -> DataFrame:
    """Samples of the selected points; a struct that structs (struct_id) does not list is null with code -1035."""
    out = rows.join(points.select("tag_id").distinct(), "tag_id", "left_semi")
    if structs is None:
        return out
    known = structs.select("struct_id", F.lit(True).alias("_known")).distinct()
    out = out.join(known, "struct_id", "left")
    strange = F.col("struct_id").isNotNull() & F.col("_known").isNull()
    return out.withColumn("status_code", F.when(strange, UNKNOWN_STRUCT).otherwise(F.col("status_code"))).withColumn("value", F.when(~strange, F.col("value"))).select(rows.columns)


def subscription(samples: DataFrame, points_path: str, out_path: str, checkpoint: str, structs_path: str | None = None):
    """A writer of the selected samples of a stream, to be started: each batch reads the tables of points and structs as they are then.

    So a point that is added or taken away counts from the next batch on, without a restart. A batch is its own partition of out_path, written over when it
    is tried again.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        structs = None if structs_path is None else spark.read.parquet(structs_path)
        upsert(selected(rows, spark.read.parquet(points_path), structs), batch_id, out_path)

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def beat_peaks(samples: DataFrame, window_s: int, interval_s: int | None = None, delay_s: int = 5) -> DataFrame:
    """Peaks and counts of each finished beat, written once, after the delay within which late samples still count."""
    w = F.window("t", f"{window_s} seconds", f"{interval_s or window_s} seconds")
    v = good_value()
    rows = samples.withWatermark("t", f"{delay_s} seconds") if samples.isStreaming else samples
    out = rows.groupBy(w.alias("w"), "binding", "role").agg(F.max(v).alias("peak"), F.avg(v).alias("mean"), F.count(v).alias("n_good"), F.count("*").alias("n"))
    return out.select("binding", "role", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "peak", "mean", "n_good", "n")


def final_values(samples: DataFrame) -> DataFrame:
    """Values that can no longer be revised: trusted, and not the pending code."""
    return samples.where(trusted(F.col("status_code")) & (F.col("status_code") != 5004))


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink of revisable samples: each batch is its own partition, so a retry replaces it; latest() reads the result."""
    batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last written version of every (tag_id, t)."""
    value = F.struct(*[c for c in rows.columns if c not in ("tag_id", "t", "batch_id")])
    return rows.groupBy("tag_id", "t").agg(F.max_by(value, "batch_id").alias("v")).select("tag_id", "t", "v.*")


def heartbeat_gaps(events: DataFrame, limit_s: float) -> DataFrame:
    """(source, from_t, to_t, seconds) of pauses between events longer than the limit."""
    from pyspark.sql import Window

    before = F.lag("t").over(Window.partitionBy("source").orderBy("t"))
    gap = (F.unix_micros("t") - F.unix_micros("from_t")) / 1e6
    return events.withColumn("from_t", before).withColumn("seconds", gap).where(F.col("seconds") > limit_s).select("source", "from_t", F.col("t").alias("to_t"), "seconds")
