"""Capture files: many text files of several channels, one row of features for each, refused ones with their reason.

Lines are split and cast in Spark, so a file is read by as many tasks as it has splits, from any store that Spark reads; what makes a file
unusable is found by the same aggregation as its statistics. Only a spectrum needs a channel as a whole: an array a file and channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.signal import sensor_scalars, spectrum_bins, with_features


def read_captures(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, place, v): the fields of each line that is not blank, as numbers or null; place orders the lines of a file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    return lines.select("file", "place", F.transform(F.split("value", separator), lambda x: F.trim(x).try_cast("double")).alias("v"))


def capture_statistics(captures: DataFrame, columns: int = 8, least_rows: int = 10_000, channels: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """(file, rows, reject, stats): per file why it is refused, or null and for each channel its mean, deviation, kurtosis and crest factor.

    Refused are files with a field that is no number, with lines of different widths, of another width than columns, and with less than
    least_rows lines. Numbers of channels count columns from 0. Files without any line are not seen at all.
    """
    width, bad = F.size("v"), F.exists("v", lambda x: x.isNull() | F.isnan(x))
    x = {c: F.get("v", c) for c in channels}

    def stats(c: int) -> Column:
        mean, deviation = F.avg(x[c]), F.nullif(F.stddev_pop(x[c]), F.lit(0.0))
        top = F.greatest(F.max(x[c]) - mean, mean - F.min(x[c]))
        return F.struct(F.lit(c).alias("channel"), mean.alias("mean"), F.stddev_pop(x[c]).alias("deviation"), F.when(deviation.isNotNull(), F.kurtosis(x[c]) + 3).alias("kurt"), (top / deviation).alias("crest"))

    out = captures.groupBy("file").agg(
        F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.min(width).alias("narrow"), F.max(width).alias("wide"), F.array(*[stats(c) for c in channels]).alias("stats")
    )
    reject = (
        F.when(F.col("bad") > 0, F.concat(F.lit("not numbers: "), "bad", F.lit(" lines")))
        .when(F.col("narrow") != F.col("wide"), F.concat(F.lit("ragged: "), "narrow", F.lit(" to "), "wide", F.lit(" columns")))
        .when(F.col("wide") != columns, F.concat(F.lit("columns: "), "wide"))
        .when(F.col("rows") < least_rows, F.concat(F.lit("short: "), "rows", F.lit(" rows")))
    )
    return out.select("file", "rows", reject.alias("reject"), "stats").withColumn("stats", F.when(F.col("reject").isNull(), F.col("stats")))


def capture_waves(captures: DataFrame, accepted: DataFrame, fs: float, channels: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """(file, channel, wave, fs) of the accepted files."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.get("v", c).alias("x")) for c in channels])
    rows = captures.join(accepted.select("file"), "file", "left_semi").select("file", "place", F.inline(each))
    waves = rows.groupBy("file", "channel").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("w"))
    return waves.select("file", "channel", F.col("w.x").alias("wave"), F.lit(float(fs)).alias("fs"))


def read_capture_features(
    spark: SparkSession, path: str, fs: float, columns: int = 8, least_rows: int = 10_000, channels: tuple[int, ...] = (1, 2, 3, 4, 5, 6), bins: int = 20
) -> DataFrame:
    """One row a file: (file, label, speed, rows, reject, channels), label its folder, speed its name as a number.

    channels has for each channel its statistics, sensor scalars (acc, vel, disp, freq) and the largest amplitude in each of bins ranges
    of frequency; null for a refused file.
    """
    captures = read_captures(spark, path)
    told = capture_statistics(captures, columns, least_rows, channels)
    scalars, lines = ("acc", "vel", "disp", "freq"), [f"bin{i}" for i in range(bins)]

    def features(x, args):
        return sensor_scalars(x, args["fs"]) | dict(zip(lines, spectrum_bins(x, args["fs"], bins).T))

    waves = with_features(capture_waves(captures, told.where("reject IS NULL"), fs, channels), features, [*scalars, *lines], ["fs"])
    parts = waves.select("file", F.struct("channel", *scalars, F.array(*lines).alias("bins")).alias("s")).groupBy("file").agg(F.array_sort(F.collect_list("s")).alias("spectra"))
    both = lambda a, b: F.struct(*[a[n].alias(n) for n in ("channel", "mean", "deviation", "kurt", "crest")], *[b[n].alias(n) for n in (*scalars, "bins")])
    name = F.split("file", "/")
    out = told.join(parts, "file", "left").withColumn("channels", F.zip_with(F.array_sort("stats"), "spectra", both))
    speed = F.regexp_replace(F.element_at(name, -1), r"\.[A-Za-z]+$", "").try_cast("double")
    return out.select("file", F.element_at(name, -2).alias("label"), speed.alias("speed"), "rows", "reject", "channels")
