"""Bucketed history: exactly one row for each point and bucket, with a reason where there is no value.

The methods' names are given elsewhere; these formulas are this package's own. Average, Total and Std weigh each
good value by the time it holds within the bucket, until the next sample of any quality; the last sample of the range
holds to the range's end. Interpolation is linear between the last good sample before an edge and the first after it, and does not
bridge a bad one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.quality import finite, trusted

EMPTY, PAST_LAST = -1028, -1027


def grid(points: DataFrame, begin: int, end: int, interval: int) -> DataFrame:
    """(tag_id, bucket, start): every bucket of [begin, end) epoch seconds for every point."""
    n = (end - begin) // interval
    rows = points.select("tag_id").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("start", F.timestamp_seconds(F.lit(begin) + F.col("bucket") * interval))


def _good(samples: DataFrame, begin: int, end: int) -> DataFrame:
    inside = samples.where((F.unix_micros("t") >= begin * 1_000_000) & (F.unix_micros("t") < end * 1_000_000))
    return inside.withColumn("v", F.when(trusted(F.col("status_code")), finite(F.col("value")))).withColumn("us", F.unix_micros("t"))


def _completed(stats: DataFrame, samples: DataFrame, points: DataFrame, begin: int, end: int, interval: int, value: str) -> DataFrame:
    """stats on the whole grid, with reason.

    The grid is much larger than the points that it is made from, which is what Spark would judge its size by.
    """
    last = samples.where(F.unix_micros("t") < end * 1_000_000).groupBy("tag_id").agg(F.max(F.unix_micros("t")).alias("last_us"))
    out = grid(points, begin, end, interval).hint("merge").join(stats, ["tag_id", "bucket"], "left").join(last, "tag_id", "left")
    past = F.coalesce(F.unix_micros("start") > F.col("last_us"), F.lit(True))
    return out.withColumn("reason", F.when(F.col(value).isNotNull(), F.lit(None).cast("int")).when(past, PAST_LAST).otherwise(EMPTY)).drop("last_us")


def occupied(samples: DataFrame, begin: int, end: int, interval: int) -> DataFrame:
    """Plain statistics of good samples by bucket that has any, and the samples at the extremes with their own times."""
    rows = _good(samples, begin, end).where("v IS NOT NULL").withColumn("bucket", F.floor((F.col("us") - begin * 1_000_000) / (interval * 1_000_000)).cast("int"))
    first, last = F.struct("us", "seq"), F.struct("us", "seq")
    stats = rows.groupBy("tag_id", "bucket").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.min_by("t", F.struct("v", "us")).alias("low_t"), F.max_by("t", F.struct("v", -F.col("us"))).alias("high_t"),
        F.min_by("v", first).alias("first_value"), F.max_by("v", last).alias("last_value"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )
    return stats.withColumn("changed", F.col("last_value") - F.col("first_value")).withColumn("max_changed", F.col("high") - F.col("low"))


def statistics(samples: DataFrame, points: DataFrame, begin: int, end: int, interval: int) -> DataFrame:
    """The statistics of occupied for every bucket of every point."""
    out = occupied(samples, begin, end, interval)
    return _completed(out, samples, points, begin, end, interval, "mean").withColumn("n", F.coalesce("n", F.lit(0)))


def weighted(samples: DataFrame, points: DataFrame, begin: int, end: int, interval: int) -> DataFrame:
    """Time-weighted average, total and deviation, and seconds of good value, by bucket."""
    w = Window.partitionBy("tag_id").orderBy("us", "seq")
    rows = _good(samples, begin, end).withColumn("until", F.coalesce(F.lead("us").over(w), F.lit(end * 1_000_000).cast("long"))).where("v IS NOT NULL AND until > us")
    size = interval * 1_000_000
    at = lambda c: F.floor((c - begin * 1_000_000) / size).cast("int")
    rows = rows.withColumn("bucket", F.explode(F.sequence(at(F.col("us")), at(F.col("until") - 1))))
    lo, hi = F.lit(begin * 1_000_000) + F.col("bucket") * F.lit(size).cast("long"), F.lit(begin * 1_000_000) + (F.col("bucket") + 1) * F.lit(size).cast("long")
    rows = rows.withColumn("dt", (F.least("until", hi) - F.greatest("us", lo)) / 1e6)
    s = rows.groupBy("tag_id", "bucket").agg(F.sum("dt").alias("time_good"), F.sum(F.col("v") * F.col("dt")).alias("total"), F.sum(F.col("v") * F.col("v") * F.col("dt")).alias("s2"))
    mean = F.col("total") / F.col("time_good")
    s = s.withColumn("average", mean).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("time_good") - mean * mean))).drop("s2")
    return _completed(s, samples, points, begin, end, interval, "average").withColumn("time_good", F.coalesce("time_good", F.lit(0.0)))


def change_count(samples: DataFrame, points: DataFrame, begin: int, end: int, interval: int) -> DataFrame:
    """How often the good value changes within each bucket, from the sample before on."""
    w = Window.partitionBy("tag_id").orderBy("us", "seq")
    rows = _good(samples, begin, end).where("v IS NOT NULL").withColumn("moved", (F.col("v") != F.lag("v").over(w)).cast("int"))
    rows = rows.withColumn("bucket", F.floor((F.col("us") - begin * 1_000_000) / (interval * 1_000_000)).cast("int"))
    s = rows.groupBy("tag_id", "bucket").agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("changes"))
    return _completed(s, samples, points, begin, end, interval, "changes")


def interpolated(samples: DataFrame, points: DataFrame, begin: int, end: int, interval: int, at_end: bool = False) -> DataFrame:
    """The value at each bucket's start, or end, between the samples around it."""
    size = interval * 1_000_000
    rows = _good(samples, begin, end).select("tag_id", "us", "seq", "v", (F.col("v").isNotNull()).alias("ok"), F.lit(None).cast("int").alias("bucket"))
    edge = F.lit(begin * 1_000_000).cast("long") + (F.col("bucket") + int(at_end)) * F.lit(size).cast("long")
    edges = grid(points, begin, end, interval).select("tag_id", edge.alias("us"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("boolean").alias("ok"), "bucket")
    both = rows.union(edges)
    back = Window.partitionBy("tag_id").orderBy("us", F.col("bucket").isNotNull(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("tag_id").orderBy(F.desc("us"), F.col("bucket").isNotNull(), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    sample = F.when(F.col("bucket").isNull(), F.struct("us", "v"))
    both = both.withColumn("p", F.last(sample, ignorenulls=True).over(back)).withColumn("q", F.last(sample, ignorenulls=True).over(ahead)).where("bucket IS NOT NULL")
    v = F.when(F.col("p.us") == F.col("us"), F.col("p.v")).when(F.col("q.us") == F.col("us"), F.col("q.v"))
    v = F.coalesce(v, F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("us") - F.col("p.us")) / F.nullif(F.col("q.us") - F.col("p.us"), F.lit(0)))
    return _completed(both.select("tag_id", "bucket", v.alias("value")), samples, points, begin, end, interval, "value")


def trend(samples: DataFrame, begin: int, end: int, interval: int) -> DataFrame:
    """First, least, largest and last good sample of each bucket at their own times, each sample once."""
    rows = _good(samples, begin, end).where("v IS NOT NULL").withColumn("bucket", F.floor((F.col("us") - begin * 1_000_000) / (interval * 1_000_000)).cast("int"))
    w = Window.partitionBy("tag_id", "bucket")
    for name, order in {"a": ["us", "seq"], "b": [F.desc("us"), F.desc("seq")], "c": ["v", "us", "seq"], "d": [F.desc("v"), "us", "seq"]}.items():
        rows = rows.withColumn(name, F.row_number().over(w.orderBy(*order)))
    return rows.where("a = 1 OR b = 1 OR c = 1 OR d = 1").select("tag_id", "bucket", "t", "seq", F.col("v").alias("value"))
