"""Windows of machines and what is computed of them: peaks, means, features, baselines, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import finite, trusted

AXES, QUANTITIES = ("x", "y", "z"), ("vel", "acc", "disp", "freq")
ROLES = ["temp", *(f"{a}_{q}" for a in AXES for q in ("acc", "freq", "disp", "vel"))]
FRAME = ["binding", "window_start", "window_end"]
MIN_BASELINE_FRAMES = 5


def with_roles(samples: DataFrame, roles: DataFrame) -> DataFrame:
    """Samples with every role that their point feeds; roles is a dimension, joined as Spark sees fit."""
    return samples.join(roles.select("binding", "role", "tag_id"), "tag_id")


def aligned_tick(t: Column, seconds: int) -> Column:
    """The last whole beat at or before t, counted from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(t) / (seconds * 1_000_000)) * seconds)


def frames(samples: DataFrame, window_s: int, interval_s: int | None = None, margin_s: int = 0) -> DataFrame:
    """Samples with the windows [start, end) that hold them; margin_s ends every window earlier, for values that arrive late."""
    t = F.col("t") if not margin_s else F.col("t") + F.make_interval(secs=F.lit(margin_s))
    w = F.window(t, f"{window_s} seconds", f"{interval_s or window_s} seconds")
    return samples.withColumn("w", w).withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")


def good_value() -> Column:
    return F.when(trusted(F.col("status_code")), finite(F.col("value")))


def axis_peaks(framed: DataFrame, by: list[str] = FRAME, quantity: str = "vel") -> DataFrame:
    """(by, role, peak, peak_t, all_bad): each axis' largest trusted value and the time of its first occurrence."""
    v = good_value()
    rows = framed.where(F.col("role").isin([f"{a}_{quantity}" for a in AXES])).withColumn("v", v)
    key = F.struct(F.col("v"), -F.unix_micros("t"))
    out = rows.groupBy(*by, "role").agg(F.max("v").alias("peak"), F.max_by("t", F.when(F.col("v").isNotNull(), key)).alias("peak_t"), F.count("v").alias("n_good"))
    return out.withColumn("all_bad", F.col("n_good") == 0)


def pivoted_peaks(framed: DataFrame, by: list[str] = FRAME, quantity: str = "vel") -> DataFrame:
    """(by, x, y, z, t_x, t_y, t_z, has_samples): one row a frame."""
    v = good_value()
    rows = framed.withColumn("v", v)
    aggs = []
    for a in AXES:
        mine = F.when(F.col("role") == f"{a}_{quantity}", F.col("v"))
        aggs += [F.max(mine).alias(a), F.max_by("t", F.when(mine.isNotNull(), F.struct(mine, -F.unix_micros("t")))).alias(f"t_{a}")]
    return rows.groupBy(*by).agg(*aggs, F.count("v").alias("n_good"), F.count("*").alias("n"))


def features13(framed: DataFrame, by: list[str] = FRAME) -> DataFrame:
    """The 13 scalars of a frame: peaks of velocity, acceleration and displacement, means of frequency and temperature."""
    rows = framed.withColumn("v", good_value())
    aggs = []
    for role in ROLES:
        mine = F.when(F.col("role") == role, F.col("v"))
        aggs.append((F.avg(mine) if role == "temp" or role.endswith("freq") else F.max(mine)).alias(role))
    return rows.groupBy(*by).agg(*aggs)


def median_iqr(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, iqr, n) by linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*by).agg(p.alias("p"), F.count(value).alias("n")).select(*by, F.col("p")[1].alias("median"), (F.col("p")[2] - F.col("p")[0]).alias("iqr"), "n")


def baseline_documents(features: DataFrame, by: list[str]) -> DataFrame:
    """One row a set: of each role of features13 the median, iqr and number (role_m, role_i, role_n) over the running frames, in one aggregate.

    A set of under MIN_BASELINE_FRAMES running frames, or with one in zone C or D, is refused as a whole, and a role of too few values is
    null. With the columns axial and window_start the row also has base_axial and base_ratio, the axial over the largest radial
    median of velocity, and t_from and t_to, the first and the last frame.
    """
    roles = [r for r in ROLES if r in features.columns]
    third = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    aggs = [F.count("*").alias("frames"), F.max(F.coalesce(F.col("zone").isin("C", "D"), F.lit(False))).alias("bad")]
    aggs += [a for r in roles for a in (F.percentile(r, third).alias(f"{r}_p"), F.count(r).alias(f"{r}_n"))]
    if "window_start" in features.columns:
        aggs += [F.min("window_start").alias("t_from"), F.max("window_start").alias("t_to")]
    if "axial" in features.columns:
        aggs.append(F.max("axial").alias("base_axial"))
    out = features.where("running").groupBy(*by).agg(*aggs).where((F.col("frames") >= MIN_BASELINE_FRAMES) & ~F.col("bad")).drop("bad")
    for r in roles:
        enough = F.col(f"{r}_n") >= MIN_BASELINE_FRAMES
        out = out.withColumn(f"{r}_m", F.when(enough, F.col(f"{r}_p")[1])).withColumn(f"{r}_i", F.when(enough, F.col(f"{r}_p")[2] - F.col(f"{r}_p")[0])).drop(f"{r}_p")
    if "base_axial" in out.columns:
        from ..functions.rules import axial_ratio

        medians = [F.col(f"{a}_vel_m") if f"{a}_vel" in roles else F.lit(None).cast("double") for a in AXES]
        out = out.withColumn("base_ratio", axial_ratio(*medians, F.col("base_axial"), still=None))
    return out


def baseline(features: DataFrame, by: list[str]) -> DataFrame:
    """(by, frames, role, median, iqr, n): baseline_documents in rows, a role each."""
    docs = baseline_documents(features, by)
    roles = [r for r in ROLES if r in features.columns]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_m").alias("median"), F.col(f"{r}_i").alias("iqr"), F.col(f"{r}_n").alias("n")) for r in roles]))
    return docs.select(*by, "frames", each.alias("r")).select(*by, "frames", "r.*").where("median IS NOT NULL")


def refused_baselines(features: DataFrame, by: list[str], peak: str) -> DataFrame:
    """The worst frame of each set refused for zone C or D."""
    bad = features.where("running").where(F.col("zone").isin("C", "D"))
    return bad.groupBy(*by).agg(F.max(peak).alias("worst"), F.max_by("window_start", F.struct(F.col(peak), -F.unix_micros("window_start"))).alias("worst_start"), F.count("*").alias("bad_frames"))


def tail_n(framed: DataFrame, n: int, channels: list[str], rate_hz: float | None = None, by: list[str] = FRAME) -> DataFrame:
    """(by, quality, reason, tail) of the last n samples of each channel; nothing is filled.

    tail maps a channel to its values in time order. All channels absent is no_input; one that is short, bad or, with a
    rate, spread by more than 25 % from (n - 1) / rate, is insufficient_samples.
    """
    rows = framed.where(F.col("role").isin(channels)).withColumn("v", good_value())
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by, "role").orderBy(F.desc("t"), F.desc("seq")))).where(F.col("k") <= n)
    each = last.groupBy(*by, "role").agg(
        F.count("*").alias("got"),
        F.count("v").alias("good"),
        ((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6).alias("span"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "v"))), lambda x: x["v"]).alias("values"),
    )
    off = F.lit(False) if rate_hz is None else F.abs(F.col("span") - (n - 1) / rate_hz) > 0.25 * (n - 1) / rate_hz
    bad = F.when(F.col("got") < n, F.concat("role", F.lit(": short"))).when(F.col("good") < n, F.concat("role", F.lit(": bad"))).when(off, F.concat("role", F.lit(": spacing")))
    out = framed.select(*by).distinct().join(each.withColumn("bad", bad), by, "left").groupBy(*by).agg(
        F.count("role").alias("seen"), F.min("bad").alias("bad"), F.map_from_entries(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role", "values")))).alias("tail")
    )
    quality = F.when(F.col("seen") == 0, "no_input").when((F.col("seen") < len(channels)) | F.col("bad").isNotNull(), "insufficient_samples").otherwise("ok")
    reason = F.when(F.col("seen") == 0, "no channel").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("seen") < len(channels), "channel missing")
    return out.select(*by, quality.alias("quality"), reason.alias("reason"), F.when(quality == "ok", F.col("tail")).alias("tail"))


def latest_event(events: DataFrame, by: list[str]) -> DataFrame:
    """The last event of each window, at its own time."""
    return events.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("seq")))).where("k = 1").drop("k")


def split_span(spans: DataFrame, window_s: int) -> DataFrame:
    """Whole windows of labelled spans (t_from, t_to) from the start on, with 1 ms of grace; a short tail is dropped.

    The last window of a span also takes its right end: closed is true there.
    """
    n = F.floor((F.unix_micros("t_to") - F.unix_micros("t_from") + 1000) / (window_s * 1_000_000)).cast("int")
    rows = spans.withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.timestamp_micros(F.unix_micros("t_from") + F.col("k").cast("long") * window_s * 1_000_000)
    end = F.timestamp_micros(F.unix_micros("t_from") + (F.col("k") + 1).cast("long") * window_s * 1_000_000)
    return rows.withColumn("window_start", start).withColumn("window_end", end).withColumn("closed", F.col("k") == F.col("n") - 1).drop("n", "k")


WINDOW = ["binding", "window_start", "window_end", "closed"]


def _met(windows: DataFrame, samples: DataFrame, bucket_s: int) -> DataFrame:
    """Windows with the samples inside them: both sides meet on the binding and on buckets of time, so that the join has an equality.

    A sample has one bucket and a window those that it touches.
    """
    of = lambda t: F.floor(t / (bucket_s * 1_000_000))
    last = F.unix_micros("window_end") - F.when(F.col("closed"), 0).otherwise(1)
    wide = windows.withColumn("bucket", F.explode(F.sequence(of(F.unix_micros("window_start")), of(last))))
    s = samples.withColumn("sb", of(F.unix_micros("t"))).withColumnRenamed("binding", "b")
    inside = (F.col("t") >= F.col("window_start")) & ((F.col("t") < F.col("window_end")) | (F.col("closed") & (F.col("t") == F.col("window_end"))))
    return wide.join(s, (F.col("binding") == F.col("b")) & (F.col("bucket") == F.col("sb")) & inside).drop("b", "sb", "bucket")


def samples_in_windows(windows: DataFrame, samples: DataFrame, bucket_s: int = 86400) -> DataFrame:
    """Windows (WINDOW and more) with their samples; a window without any stays, with null samples."""
    met = _met(windows, samples, bucket_s)
    empty = windows.join(met.select(*WINDOW).distinct(), WINDOW, "left_anti")
    return met.unionByName(empty, allowMissingColumns=True)


def aggregated_in_windows(windows: DataFrame, samples: DataFrame, aggs: list[Column], bucket_s: int = 86400) -> DataFrame:
    """Windows (WINDOW and more) with aggregates of their samples, null for a window without any.

    Equal windows of one binding are joined to samples once, and only their aggregates go back to the rows that have them.
    """
    each = _met(windows.select(*WINDOW).distinct(), samples, bucket_s).groupBy(*WINDOW).agg(*aggs)
    return windows.join(each, WINDOW, "left")


def frame_gate(spans: DataFrame, window_s: int, by: list[str], most_frames: int = 5000, most_samples: int = 20000) -> DataFrame:
    """Windows and samples that each job would read, from metadata only, and why it is refused."""
    n = F.floor((F.unix_micros("t_to") - F.unix_micros("t_from") + 1000) / (window_s * 1_000_000))
    out = spans.groupBy(*by).agg(F.sum(F.greatest(n, F.lit(0))).alias("frames"), F.count("*").alias("samples"))
    return out.withColumn("refused", F.when(F.col("samples") > most_samples, "too many samples").when(F.col("frames") > most_frames, "too many frames"))
