"""From samples to findings: peaks, zones, status, baselines and deviation for every machine and window at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules
from ..operators import frames


def graded_windows(samples: DataFrame, machines: DataFrame, window_s: int, interval_s: int | None = None, margin_s: int = 0) -> DataFrame:
    """One row a frame: peaks of each axis, the graded peak, its zone and margin, and the status.

    machines: (binding, axial, limits, custom), a dimension.
    """
    peaks = frames.pivoted_peaks(frames.frames(samples, window_s, interval_s, margin_s))
    out = peaks.join(machines, "binding")
    peak = rules.radial_peak(F.col("x"), F.col("y"), F.col("z"), F.col("axial"))
    out = out.withColumn("peak", peak).withColumn("zone", rules.severity_zone(F.col("peak"), F.col("limits")))
    out = out.withColumn("margin", rules.zone_margin(F.col("peak"), F.col("limits"))).withColumn("status", rules.zone_status(F.col("zone"), F.col("custom")))
    return out.withColumn("quality", F.when(F.col("status").isNotNull(), "ok").when(F.col("n_good") > 0, "insufficient_samples").when(F.col("n") > 0, "input_bad").otherwise("no_input"))


def to_findings(graded: DataFrame) -> DataFrame:
    """Findings (binding, key, value, text, quality, t) of graded windows: status and zone as text, peak and margin as numbers.

    With a column run_state, that is a finding too, and of a stopped machine status and zone say stopped and no numbers are
    written.
    """
    none = F.lit(None)
    item = lambda key, value, text: F.struct(F.lit(key).alias("key"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    items = F.array(item("status", none, F.col("status")), item("zone", none, F.col("zone")), item("vel_radial", F.col("peak"), none), item("margin", F.col("margin"), none))
    quality = F.col("quality")
    if "run_state" in graded.columns:
        stopped, state = F.col("run_state") == "stopped", item("run_state", none, F.col("run_state"))
        still = F.array(item("status", none, F.lit("stopped")), item("zone", none, F.lit("stopped")), state)
        items = F.when(stopped, still).otherwise(F.array_append(items, state))
        quality = F.when(stopped, "ok").otherwise(quality)
    return graded.select("binding", F.explode(items).alias("i"), quality.alias("quality"), F.col("window_end").alias("t")).select("binding", "i.key", "i.value", "i.text", "quality", "t")


def anchor_enabled(windows: DataFrame, outputs: dict[str, list[str]], quality: str) -> DataFrame:
    """(windows' columns, key, value, quality): a bad value for every output of the parts that are enabled, where none can be computed.

    windows have algorithms and fault_classify, the settings; outputs are keys by part, of classic, baseline, classify and any
    other, which is always enabled. A method setting that is illegal puts config_incomplete on the outputs of all methods; outputs of a
    part that is not enabled are not written.
    """
    rows = windows.withColumn("_on", rules.algorithms(F.col("algorithms"))).withColumn("_classify", rules.classify_enabled(F.col("fault_classify")))
    enabled = {"classic": F.coalesce(F.array_contains("_on", "classic"), F.lit(True)), "baseline": F.coalesce(F.array_contains("_on", "baseline"), F.lit(True)), "classify": F.coalesce("_classify", F.lit(True))}
    keys = F.flatten(F.array(*[F.when(enabled.get(part, F.lit(True)), F.array(*map(F.lit, ks))).otherwise(F.array().cast("array<string>")) for part, ks in outputs.items()]))
    out = rows.withColumn("key", F.explode(keys)).withColumn("value", F.lit(None).cast("double"))
    return out.withColumn("quality", F.when(F.col("_on").isNull(), "config_incomplete").otherwise(quality)).drop("_on", "_classify")


def deviation(features: DataFrame, base: DataFrame) -> DataFrame:
    """features (binding, roles, and axial or not) beside baseline_documents: deviations of each quantity, drift, rise and score.

    vel_z, acc_z, disp_z: the largest z of the axes; freq_z: that of the largest size, with its sign; each with its quality: no_input
    where neither frame nor baseline has the quantity, model_not_loaded where only the frame has it, insufficient_samples where only
    the baseline does. ratio_drift: axial ratio less the baseline's, model_not_loaded where the axial axis is another since. The score
    counts the largest of velocity, acceleration and displacement; it needs velocity.
    """
    roles = [r for r in frames.ROLES if f"{r}_m" in base.columns]
    known = [c for r in roles for c in (f"{r}_m", f"{r}_i")] + [c for c in ("base_axial", "base_ratio") if c in base.columns]
    out = features.join(base.select("binding", *known), "binding", "left")
    value = lambda r: F.col(r) if r in features.columns else F.lit(None).cast("double")
    part = lambda r, k: F.col(f"{r}_{k}") if r in roles else F.lit(None).cast("double")
    for q in frames.QUANTITIES:
        of = [f"{a}_{q}" for a in frames.AXES]
        z = [rules.robust_z(value(r), part(r, "m"), part(r, "i"), q) for r in of]
        if q == "freq":
            top = F.array_max(F.filter(F.array(*[F.struct(F.abs(x).alias("size"), x.alias("z")) for x in z]), lambda s: s["z"].isNotNull()))["z"]
        else:
            top = F.greatest(*z)
        seen, based = F.coalesce(*map(value, of)).isNotNull(), F.coalesce(*[part(r, "m") for r in of]).isNotNull()
        quality = F.when(F.col(f"{q}_z").isNotNull(), "ok").when(~seen & ~based, "no_input").when(~based, "model_not_loaded").otherwise("insufficient_samples")
        out = out.withColumn(f"{q}_z", top).withColumn(f"{q}_quality", quality)
    temp, warm = value("temp"), part("temp", "m")
    out = out.withColumn("temp_rise", temp - warm).withColumn("temp_quality", F.when((temp - warm).isNotNull(), "ok").when(temp.isNotNull(), "model_not_loaded").otherwise("no_input"))
    if "axial" in features.columns and "base_ratio" in base.columns:
        axial = F.lower(F.trim(F.coalesce("axial", F.lit(""))))
        now = rules.axial_ratio(*[value(f"{a}_vel") for a in frames.AXES], axial, still=None)
        told = axial.isin(*frames.AXES) & F.col("base_ratio").isNotNull()
        drift = F.when(told & (F.col("base_axial") == axial), now - F.col("base_ratio"))
        quality = F.when(~told, "config_incomplete").when(F.col("base_axial") != axial, "model_not_loaded").when(now.isNull(), "insufficient_samples").otherwise("ok")
        out = out.withColumn("ratio_drift", drift).withColumn("ratio_quality", quality)
    else:
        out = out.withColumn("ratio_drift", F.lit(None).cast("double")).withColumn("ratio_quality", F.lit("config_incomplete"))
    top = F.when(F.col("vel_z").isNotNull(), F.greatest("vel_z", "acc_z", "disp_z"))
    score = rules.anomaly_score(top, F.col("ratio_drift"), F.col("temp_rise"))
    quality = F.when(F.coalesce(*[part(r, "m") for r in roles]).isNull(), "model_not_loaded").when(F.col("vel_z").isNull(), "insufficient_samples").otherwise("ok")
    return out.withColumn("anomaly_score", score).withColumn("quality", quality).drop(*known)


def replay(samples: DataFrame, machines: DataFrame, segment: tuple, window_s: int) -> DataFrame:
    """Graded windows of a whole archived range (begin, end), as a result of its own that is not written back."""
    begin, end = segment
    return graded_windows(samples.where((F.col("t") >= begin) & (F.col("t") < end)), machines, window_s)
