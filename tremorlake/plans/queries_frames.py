"""Queries on quality, frames, grading, baselines and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import quality, rules
from ..operators import evaluation, frames, labels
from ..sources import samples as src
from . import diagnosis
from .inputs import ANNOTATIONS, MACHINES_SQL, PEAKS, SAMPLES, annotations, machines, plain_times, samples, table
from .registry import query

DAY = 86400


def _machine_dimension(spark: SparkSession, d: str) -> DataFrame:
    b = samples(spark, d).select("binding").distinct()
    axial = F.element_at(F.array(*map(F.lit, ("x", "y", "z", ""))), (F.col("binding") % 4 + 1).cast("int"))
    limits = F.when(F.col("binding") % 2 == 0, F.array(*map(F.lit, (10.0, 20.0, 30.0)))).otherwise(F.array(*map(F.lit, (15.0, 30.0, 40.0))))
    return b.select("binding", axial.alias("axial"), limits.alias("limits"), F.lit(False).alias("custom"))


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.graded_windows(samples(spark, d), _machine_dimension(spark, d), DAY)


@query(
    f"""WITH {PEAKS} SELECT binding, window_start, peak, zone, CASE WHEN peak <= limits[1] THEN limits[1] - peak WHEN peak <= limits[2] THEN limits[2] - peak ELSE limits[3] - peak END AS margin,
    CASE zone WHEN 'A' THEN 'normal' WHEN 'B' THEN 'normal' WHEN 'C' THEN 'warning' WHEN 'D' THEN 'danger' END AS status,
    CASE WHEN zone IS NOT NULL THEN 'ok' WHEN n_good > 0 THEN 'insufficient_samples' ELSE 'input_bad' END AS quality FROM zoned"""
)
def severity_zone(spark, d):
    return plain_times(_zoned(spark, d).select("binding", "window_start", "peak", "zone", "margin", "status", "quality"))


@query(
    f"""WITH {SAMPLES}, m AS (SELECT *, max(v) OVER (PARTITION BY binding, window_start, role) AS m FROM good WHERE role LIKE '%vel')
    SELECT binding, window_start, role, max(v) AS peak, min(CASE WHEN v = m THEN t END) AS peak_t, count(v) AS n_good, count(v) = 0 AS all_bad FROM m GROUP BY binding, window_start, role"""
)
def axis_peaks(spark, d):
    out = frames.axis_peaks(frames.frames(samples(spark, d), DAY))
    return plain_times(out.select("binding", "window_start", "role", "peak", "peak_t", "n_good", "all_bad"))


@query(f"""WITH {SAMPLES} SELECT binding, count(*) AS n, count(v) AS n_trusted, round(count(v) / count(*), 9) AS share FROM good GROUP BY binding""")
def trusted_share(spark, d):
    good = quality.trusted(F.col("status_code"))
    return samples(spark, d).groupBy("binding").agg(F.count("*").alias("n"), F.count_if(good).alias("n_trusted"), F.round(F.count_if(good) / F.count("*"), 9).alias("share"))


_QUALITY_ROWS = ", ".join(f"('{q}', {c}, {str(f).lower()}, '{s}', '{h}')" for q, c, f, s, h in quality.QUALITIES)


@query(
    f"""WITH {SAMPLES}, q(quality, status_code, is_fault, display, hint) AS (VALUES {_QUALITY_ROWS}),
    s AS (SELECT ['ok', 'input_bad', 'no_input', 'model_not_loaded', 'config_incomplete', 'insufficient_samples', 'low_confidence', 'compute_error'][1 + seq % 8] AS quality FROM samples)
    SELECT quality, any_value(q.status_code) AS status_code, any_value(is_fault) AS is_fault, any_value(display) AS display, any_value(hint) AS hint, count(*) AS n FROM s JOIN q USING (quality) GROUP BY quality"""
)
def quality_dictionary(spark, d):
    q = F.element_at(F.array(*[F.lit(r[0]) for r in quality.QUALITIES]), (F.col("seq") % 8 + 1).cast("int"))
    n = samples(spark, d).groupBy(q.alias("quality")).agg(F.count("*").alias("n"))
    c = F.col("quality")
    return n.select("quality", quality.status_code(c).alias("status_code"), quality.is_fault(c).alias("is_fault"), quality.display(c).alias("display"), quality.hint(c).alias("hint"), "n")


@query(
    """SELECT event_id % 7 AS kind, count(*) AS n, count(v) AS usable, round(sum(v), 4) AS total FROM (SELECT event_id, CASE event_id % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE value END AS v FROM events) GROUP BY 1"""
)
def numeric_only(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 7
    raw = F.when(k == 3, "true").when(k == 4, "NaN").when(k == 5, "Infinity").otherwise(F.col("value").cast("string"))
    v = quality.numeric_only(raw)
    return e.groupBy(k.alias("kind")).agg(F.count("*").alias("n"), F.count(v).alias("usable"), F.round(F.sum(v), 4).alias("total"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT binding, CASE WHEN seq % 13 = 0 THEN ' ' ELSE role END AS key, CASE WHEN seq % 11 = 0 THEN NULL ELSE value END AS value, CASE WHEN status_code > 0 THEN 'ok' ELSE 'input_bad' END AS quality FROM samples)
    SELECT CASE WHEN key = ' ' THEN 'no key' WHEN quality = 'ok' AND value IS NULL THEN 'ok without a finite value' END AS violation, quality, count(*) AS n FROM f GROUP BY 1, 2"""
)
def check_findings(spark, d):
    s = samples(spark, d)
    f = s.select("binding", F.when(F.col("seq") % 13 == 0, " ").otherwise(F.col("role")).alias("key"), F.when(F.col("seq") % 11 != 0, F.col("value")).alias("value"), F.when(F.col("status_code") > 0, "ok").otherwise("input_bad").alias("quality"), "t")
    return quality.check_findings(f).groupBy("violation", "quality").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT binding, window_start, max(value) AS top, count(v) AS n_good, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN v END AS v) FROM good) GROUP BY binding, window_start)
    SELECT binding, window_start, CASE WHEN n_good > 0 THEN top END AS value, CASE WHEN n_good > 0 THEN 'ok' ELSE 'input_bad' END AS quality FROM f"""
)
def no_input_no_ok(spark, d):
    framed = frames.frames(samples(spark, d).withColumn("status_code", F.when(F.col("seq") % 3 == 0, F.col("status_code")).otherwise(-1000)), DAY)
    f = framed.groupBy("binding", "window_start").agg(F.max("value").alias("value")).withColumn("quality", F.lit("ok"))
    return plain_times(quality.no_input_no_ok(f, framed, ["binding", "window_start"]).select("binding", "window_start", "value", "quality"))


@query(
    f"""WITH {SAMPLES}, w AS (SELECT DISTINCT binding, window_start FROM samples JOIN good USING (seq, binding))
    SELECT binding, window_start, key, CAST(NULL AS DOUBLE) AS value, 'compute_error' AS quality FROM w CROSS JOIN (VALUES ('status'), ('zone')) AS k(key)"""
)
def anchor_all(spark, d):
    w = frames.frames(samples(spark, d), DAY).select("binding", "window_start", "window_end").distinct()
    keys = spark.createDataFrame([("status",), ("zone",)], "key string")
    return plain_times(quality.anchor_all(w, keys, "compute_error").select("binding", "window_start", "key", "value", "quality"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT *, window_start + INTERVAL 12 HOUR AS half FROM good)
    SELECT role, role IN ('x_vel', 'y_vel') AND t <= half AS kept, count(*) AS n FROM f GROUP BY 1, 2"""
)
def keep_declared(spark, d):
    f = frames.frames(samples(spark, d), DAY).withColumnRenamed("role", "key").withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 12 HOURS"))
    good, rest = quality.keep_declared(f, spark.createDataFrame([("x_vel",), ("y_vel",)], "key string"))
    both = good.select("key", F.lit(True).alias("kept")).union(rest.select("key", F.lit(False).alias("kept")))
    return both.groupBy(F.col("key").alias("role"), "kept").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SAMPLES} SELECT binding, window_start, round(avg(CASE WHEN role = 'temp' THEN v END), 9) AS temp, max(CASE WHEN role = 'x_vel' THEN v END) AS x_vel, max(CASE WHEN role = 'y_vel' THEN v END) AS y_vel,
    max(CASE WHEN role = 'z_vel' THEN v END) AS z_vel, max(CASE WHEN role = 'x_acc' THEN v END) AS x_acc, CAST(NULL AS DOUBLE) AS z_freq FROM good GROUP BY binding, window_start"""
)
def features13(spark, d):
    out = frames.features13(frames.frames(samples(spark, d), DAY))
    return plain_times(out.select("binding", "window_start", F.round("temp", 9).alias("temp"), "x_vel", "y_vel", "z_vel", "x_acc", "z_freq"))


@query(
    f"""WITH {SAMPLES}, w AS (SELECT binding, role, value, status_code, unnest([date_trunc('day', t), date_trunc('day', t) - INTERVAL 1 DAY]) AS window_start FROM samples)
    SELECT binding, window_start, role, count(*) AS n, max(value) AS top FROM w GROUP BY binding, window_start, role"""
)
def sliding_frames(spark, d):
    out = frames.frames(samples(spark, d), 2 * DAY, DAY).groupBy("binding", "window_start", "role").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return plain_times(out)


@query(f"""WITH {SAMPLES} SELECT to_timestamp(floor(epoch_us(t) / 900e6) * 900)::TIMESTAMP AS tick, count(*) AS n FROM samples GROUP BY 1""")
def aligned_ticks(spark, d):
    return plain_times(samples(spark, d).groupBy(frames.aligned_tick(F.col("t"), 900).alias("tick")).agg(F.count("*").alias("n")))


_BASELINE = f"""WITH {PEAKS}, running AS (SELECT * FROM zoned WHERE peak >= 0.5), fit AS (SELECT binding FROM running GROUP BY binding HAVING count(*) >= 5 AND max(CASE WHEN zone = 'D' THEN 1 ELSE 0 END) = 0),
  long AS (SELECT binding, role, value FROM (SELECT binding, x AS x_vel, y AS y_vel, z AS z_vel, x_acc, temp FROM running SEMI JOIN fit USING (binding)) UNPIVOT (value FOR role IN (x_vel, y_vel, z_vel, x_acc, temp))),
  base AS (SELECT binding, role, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(*) AS n FROM long GROUP BY binding, role HAVING count(*) >= 5)"""


def _features_and_zones(spark, d):
    """Scalars, graded peak, axial axis and state of every frame, from one aggregate of the samples."""
    f = frames.features13(frames.frames(samples(spark, d), DAY)).join(_machine_dimension(spark, d), "binding")
    peak = rules.radial_peak(*[F.col(f"{a}_vel") for a in frames.AXES], F.col("axial"))
    f = f.withColumn("peak", peak).withColumn("zone", F.when(rules.severity_zone(F.col("peak"), F.col("limits")) == "D", "D").otherwise("A"))
    return f.withColumn("running", rules.run_state(F.col("peak"), F.lit("0.5")) == "running")


@query(_BASELINE + " SELECT binding, role, round(median, 9) AS median, round(iqr, 9) AS iqr, n FROM base")
def baseline_stats(spark, d):
    out = frames.baseline(_features_and_zones(spark, d), ["binding"])
    return out.select("binding", "role", F.round("median", 9).alias("median"), F.round("iqr", 9).alias("iqr"), "n")


@query(
    f"""WITH {PEAKS}, bad AS (SELECT * FROM zoned WHERE peak >= 0.5 AND zone = 'D')
    SELECT binding, max(peak) AS worst, arg_max(window_start, peak) AS worst_start, count(*) AS bad_frames FROM bad GROUP BY binding"""
)
def refused_baselines(spark, d):
    return plain_times(frames.refused_baselines(_features_and_zones(spark, d), ["binding"], "peak"))


_DEVIATION = (
    _BASELINE
    + """, wide AS (SELECT binding, max(CASE WHEN role = 'x_vel' THEN median END) AS xm, max(CASE WHEN role = 'x_vel' THEN iqr END) AS xi, max(CASE WHEN role = 'y_vel' THEN median END) AS ym, max(CASE WHEN role = 'y_vel' THEN iqr END) AS yi,
  max(CASE WHEN role = 'z_vel' THEN median END) AS zm, max(CASE WHEN role = 'z_vel' THEN iqr END) AS zi, max(CASE WHEN role = 'x_acc' THEN median END) AS am, max(CASE WHEN role = 'x_acc' THEN iqr END) AS ai, max(CASE WHEN role = 'temp' THEN median END) AS tm FROM base GROUP BY binding),
  cols AS (SELECT p.*, wide.* EXCLUDE (binding), nullif(greatest(coalesce((x - xm) / greatest(xi / 1.349, 0.01), -1e9), coalesce((y - ym) / greatest(yi / 1.349, 0.01), -1e9), coalesce((z - zm) / greatest(zi / 1.349, 0.01), -1e9)), -1e9) AS vel_z, (x_acc - am) / greatest(ai / 1.349, 0.01) AS acc_z, temp - tm AS rise,
    CASE axial WHEN 'x' THEN x / nullif(greatest(y, z), 0) WHEN 'y' THEN y / nullif(greatest(x, z), 0) WHEN 'z' THEN z / nullif(greatest(x, y), 0) END AS ratio, CASE axial WHEN 'x' THEN xm / nullif(greatest(ym, zm), 0) WHEN 'y' THEN ym / nullif(greatest(xm, zm), 0) WHEN 'z' THEN zm / nullif(greatest(xm, ym), 0) END AS base_ratio
    FROM zoned p LEFT JOIN wide USING (binding)),
  dev AS (SELECT *, ratio - base_ratio AS drift FROM cols)"""
)


def _deviation(spark, d):
    f = _features_and_zones(spark, d)
    return diagnosis.deviation(f, frames.baseline_documents(f, ["binding"]))


@query(
    _DEVIATION
    + """ SELECT binding, window_start, round(vel_z, 9) AS vel_z, round(rise, 9) AS temp_rise,
  round(CASE WHEN vel_z IS NOT NULL THEN 100 * (0.6 * least(1, greatest(0, greatest(vel_z, coalesce(acc_z, -1e9)) / 6)) + 0.25 * least(1, abs(coalesce(drift, 0)) / 0.5) + 0.15 * coalesce(least(1, greatest(0, rise / 10)), 0)) END, 9) AS anomaly_score FROM dev"""
)
def anomaly_score(spark, d):
    out = _deviation(spark, d)
    return plain_times(out.select("binding", "window_start", F.round("vel_z", 9).alias("vel_z"), F.round("temp_rise", 9).alias("temp_rise"), F.round("anomaly_score", 9).alias("anomaly_score")))


@query(
    _DEVIATION
    + """ SELECT binding, window_start, round(ratio, 9) AS ratio, round(drift, 9) AS ratio_drift, CASE WHEN axial = '' OR base_ratio IS NULL THEN 'config_incomplete' WHEN ratio IS NULL THEN 'insufficient_samples' ELSE 'ok' END AS ratio_quality FROM dev"""
)
def ratio_drift(spark, d):
    args = [F.col(f"{a}_vel") for a in frames.AXES]
    out = _deviation(spark, d).withColumn("ratio", rules.axial_ratio(*args, F.col("axial"), still=None))
    return plain_times(out.select("binding", "window_start", F.round("ratio", 9).alias("ratio"), F.round("ratio_drift", 9).alias("ratio_drift"), "ratio_quality"))


@query(
    _DEVIATION
    + """ SELECT binding, window_start, round(acc_z, 9) AS acc_z, CASE WHEN acc_z IS NOT NULL THEN 'ok' WHEN x_acc IS NULL AND am IS NULL THEN 'no_input' WHEN am IS NULL THEN 'model_not_loaded' ELSE 'insufficient_samples' END AS acc_quality,
  'no_input' AS freq_quality, CASE WHEN rise IS NOT NULL THEN 'ok' WHEN temp IS NOT NULL THEN 'model_not_loaded' ELSE 'no_input' END AS temp_quality FROM dev"""
)
def qty_deviation(spark, d):
    return plain_times(_deviation(spark, d).select("binding", "window_start", F.round("acc_z", 9).alias("acc_z"), "acc_quality", "freq_quality", "temp_quality"))


@query(
    f"""WITH {PEAKS}, run AS (SELECT *, (peak < 12) IS TRUE AS still FROM zoned), f AS (SELECT unnest(CASE WHEN still THEN ['status', 'zone', 'run_state'] ELSE ['status', 'zone', 'run_state', 'vel_radial', 'margin'] END) AS key, still, peak, zone, n_good FROM run)
    SELECT key, still AS stopped, CASE WHEN still OR zone IS NOT NULL THEN 'ok' WHEN n_good > 0 THEN 'insufficient_samples' ELSE 'input_bad' END AS quality, count(*) AS n, round(sum(CASE WHEN key = 'vel_radial' THEN peak END), 4) AS total FROM f GROUP BY 1, 2, 3"""
)
def stop_rule(spark, d):
    """A machine that stands still writes its state and no numbers."""
    g = _zoned(spark, d).withColumn("run_state", rules.run_state(F.col("peak"), F.lit("12")))
    f = diagnosis.to_findings(g).join(g.select("binding", F.col("window_end").alias("t"), F.coalesce(F.col("run_state") == "stopped", F.lit(False)).alias("stopped")), ["binding", "t"])
    return f.groupBy("key", "stopped", "quality").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("key") == "vel_radial", F.col("value"))), 4).alias("total"))


@query(
    """WITH m AS (SELECT p_partkey AS machine, ['classic', 'baseline', 'both', '', 'all'][1 + p_partkey % 5] AS a, ['true', 'false', '', 'yes'][1 + p_size % 4] AS c FROM part),
    e AS (SELECT machine, a IN ('classic', 'baseline', 'both') AS legal, unnest([CASE WHEN a <> 'baseline' THEN 'iso_zone' END, CASE WHEN a <> 'classic' THEN 'vel_z' END, CASE WHEN c IN ('true', 'yes') THEN 'fault_class' END, 'status']) AS key FROM m)
    SELECT machine, key, CAST(NULL AS DOUBLE) AS value, CASE WHEN legal THEN 'no_input' ELSE 'config_incomplete' END AS quality FROM e WHERE key IS NOT NULL"""
)
def algorithm_switches(spark, d):
    pick = lambda by, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col(by) % len(xs) + 1).cast("int"))
    m = table(spark, d, "part").select(F.col("p_partkey").alias("machine"), pick("p_partkey", "classic", "baseline", "both", "", "all").alias("algorithms"), pick("p_size", "true", "false", "", "yes").alias("fault_classify"))
    out = diagnosis.anchor_enabled(m, {"classic": ["iso_zone"], "baseline": ["vel_z"], "classify": ["fault_class"], "always": ["status"]}, "no_input")
    return out.select("machine", "key", "value", "quality")


@query(f"""WITH {PEAKS} SELECT binding, window_start, CASE zone WHEN 'C' THEN 600 WHEN 'D' THEN 800 ELSE 0 END AS level FROM zoned""")
def status_alarm_rows(spark, d):
    return plain_times(_zoned(spark, d).select("binding", "window_start", rules.alarm_level(F.col("status")).alias("level")))


@query(
    """SELECT s_nationkey AS domain, min(60 + s_suppkey % 600) AS shortest_s, min(60 + s_suppkey % 600) >= 300 AS slow FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 <> 0 GROUP BY s_nationkey"""
)
def slow_source_check(spark, d):
    """The shortest beat of the enabled bindings that raise alarms, and whether even that is too slow for them."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("domain"), (F.col("s_acctbal") > 0).alias("enabled"), (F.col("s_suppkey") % 3 != 0).alias("raises_alarm"), (60 + F.col("s_suppkey") % 600).alias("beat_s"))
    return labels.slow_source_check(s, ["domain"])


@query(
    f"""WITH {PEAKS}, r AS (SELECT binding, window_start, CASE axial WHEN 'x' THEN x WHEN 'y' THEN y WHEN 'z' THEN z END AS a, CASE axial WHEN 'x' THEN y WHEN 'y' THEN x WHEN 'z' THEN x END AS r1, CASE axial WHEN 'x' THEN z WHEN 'y' THEN z WHEN 'z' THEN y END AS r2 FROM graded),
    q AS (SELECT *, greatest(r1, r2) AS top, least(r1, r2) AS low FROM r)
    SELECT binding, window_start, round(CASE WHEN top > 0 THEN a / top END, 9) AS ratio, CASE WHEN a IS NULL OR top IS NULL THEN NULL WHEN r1 IS NOT NULL AND r2 IS NOT NULL AND low / top >= 0.8 AND a / top >= 0.8 THEN 'loose' WHEN a / top >= 0.5 THEN 'misaligned' ELSE 'unbalanced' END AS hint FROM q"""
)
def direction_hint(spark, d):
    p = _zoned(spark, d)
    args = [F.col(c) for c in ("x", "y", "z", "axial")]
    return plain_times(p.select("binding", "window_start", F.round(rules.axial_ratio(*args), 9).alias("ratio"), rules.direction_hint(*args).alias("hint")))


@query(
    f"""WITH {PEAKS}, s AS (SELECT binding, window_start, CASE zone WHEN 'A' THEN 0 WHEN 'B' THEN 0 WHEN 'C' THEN 2 WHEN 'D' THEN 3 END AS c, CASE WHEN temp >= 5 THEN 1 WHEN temp IS NOT NULL THEN 0 END AS o FROM zoned), t AS (SELECT *, greatest(coalesce(c, -1), coalesce(o, -1)) AS top FROM s)
    SELECT binding, window_start, CASE WHEN top > 0 OR (c IS NOT NULL AND top >= 0) THEN ['normal', 'attention', 'warning', 'danger'][top + 1] END AS status,
    CASE WHEN top > 0 THEN 'ok' WHEN c IS NULL THEN 'insufficient_samples' ELSE 'ok' END AS quality, CASE WHEN c >= 2 AND o = 0 THEN 'high but unchanged' WHEN c = 0 AND o = 1 THEN 'early change' END AS note FROM t"""
)
def combine_status(spark, d):
    p = _zoned(spark, d).join(frames.features13(frames.frames(samples(spark, d), DAY)).select("binding", "window_start", "temp"), ["binding", "window_start"])
    own = F.when(F.col("temp") >= 5, "attention").when(F.col("temp").isNotNull(), "normal")
    c = rules.combine_status(F.col("status"), F.when(F.col("status").isNull(), "insufficient_samples"), own, F.when(own.isNull(), "no_input"))
    return plain_times(p.select("binding", "window_start", c["status"].alias("status"), c["quality"].alias("quality"), rules.disagreement(F.col("status"), own).alias("note")))


@query(
    f"""WITH {PEAKS} SELECT window_start, ['normal', 'attention', 'warning', 'danger'][1 + max(CASE zone WHEN 'A' THEN 0 WHEN 'B' THEN 0 WHEN 'C' THEN 2 WHEN 'D' THEN 3 END)] AS status FROM zoned WHERE zone IS NOT NULL GROUP BY window_start"""
)
def device_status(spark, d):
    by = _zoned(spark, d).where("status IS NOT NULL").groupBy("window_start").agg(F.collect_set("status").alias("s"))
    return plain_times(by.select("window_start", rules.device_status(F.col("s")).alias("status")))


@query(
    f"""WITH {PEAKS}, r AS (SELECT binding % 5 AS device, window_start, CASE WHEN (peak < 12) IS TRUE THEN 'stopped' WHEN zone IN ('A', 'B') THEN 'normal' WHEN zone = 'C' THEN 'warning' WHEN zone = 'D' THEN 'danger' END AS text FROM zoned WHERE binding % 7 > 0)
    SELECT device, window_start, ['normal', 'attention', 'warning', 'danger'][1 + max(CASE text WHEN 'normal' THEN 0 WHEN 'warning' THEN 2 WHEN 'danger' THEN 3 END)] AS status, count(*) FILTER (text = 'stopped') AS stopped, count(text) AS modules FROM r WHERE text IS NOT NULL GROUP BY device, window_start"""
)
def device_statuses(spark, d):
    """Devices of five modules each: their highest status, and how many stand still; outputs that are no status say nothing."""
    g = _zoned(spark, d).withColumn("run_state", rules.run_state(F.col("peak"), F.lit("12")))
    f = diagnosis.to_findings(g).withColumn("domain", F.col("binding") % 7).withColumn("device", F.col("binding") % 5).withColumn("window_start", F.col("t") - F.expr("INTERVAL 1 DAY"))
    outputs = table(spark, d, "nation").select((F.col("n_nationkey") % 7).alias("domain"), F.lit("status").alias("key"), (F.col("n_nationkey") % 7 > 0).alias("is_status")).distinct()
    outputs = outputs.union(outputs.select("domain", F.lit("zone"), F.lit(False)))
    return plain_times(rules.device_statuses(f, outputs, ["device", "window_start"]))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY binding, window_start, role ORDER BY t DESC, seq DESC) AS k FROM good WHERE role IN ('x_vel', 'y_vel')),
    e AS (SELECT binding, window_start, role, count(*) AS got, count(v) AS ok, (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS span FROM r WHERE k <= 2 GROUP BY ALL),
    f AS (SELECT DISTINCT binding, window_start FROM good), a AS (SELECT f.binding, f.window_start, count(role) AS seen, min(CASE WHEN got < 2 THEN role || ': short' WHEN ok < 2 THEN role || ': bad' WHEN abs(span - 7200) > 1800 THEN role || ': spacing' END) AS bad FROM f LEFT JOIN e USING (binding, window_start) GROUP BY ALL)
    SELECT binding, window_start, CASE WHEN seen = 0 THEN 'no_input' WHEN seen < 2 OR bad IS NOT NULL THEN 'insufficient_samples' ELSE 'ok' END AS quality, CASE WHEN seen = 0 THEN 'no channel' WHEN bad IS NOT NULL THEN bad WHEN seen < 2 THEN 'channel missing' END AS reason FROM a"""
)
def tail_spacing(spark, d):
    """The last two samples of two channels, which must be two hours apart within a quarter."""
    return plain_times(frames.tail_n(frames.frames(samples(spark, d), DAY), 2, ["x_vel", "y_vel"], 1 / 7200).select("binding", "window_start", "quality", "reason"))


@query(
    """WITH b AS (SELECT event_id, props, length(props) AS n FROM events), c AS (SELECT event_id, n, unnest(range(1, n + 1)) AS i, props FROM b), v AS (SELECT event_id, n, i, ascii(substr(props, i, 1)) AS x FROM c)
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN n WHEN n % 2 = 0 THEN n // 2 END AS items, CASE WHEN event_id % 2 = 0 THEN sum(x) WHEN n % 2 = 0 THEN sum(CASE WHEN i % 2 = 1 THEN 256 * x ELSE x END) END::DOUBLE AS total FROM v GROUP BY event_id, n"""
)
def decoded_bytes(spark, d):
    """Texts as buffers of unsigned bytes, every second one of unsigned big-endian pairs of bytes; null where half a pair is left."""
    e = table(spark, d, "events")
    rows = e.select("event_id", F.lit(1).alias("struct_id"), F.lit(1).alias("version"), (F.col("event_id") % 2).cast("int").alias("number"), F.encode("props", "utf-8").alias("payload"))
    kind = F.when(F.col("n_nationkey") == 0, "u1").otherwise("u2")
    fields = table(spark, d, "nation").where("n_nationkey < 2").select(F.lit(1).alias("struct_id"), F.lit(1).alias("version"), F.col("n_nationkey").cast("int").alias("number"), kind.alias("dtype"), F.lit(True).alias("big_endian"))
    out = src.decode_structs(rows, fields)
    total = F.when(F.col("values").isNotNull(), F.aggregate("values", F.lit(0.0), lambda a, x: a + x))
    return out.select("event_id", F.when(F.col("values").isNotNull(), F.size("values")).cast("long").alias("items"), total.alias("total"))


_GRADING = f"""WITH {MACHINES_SQL}, m AS (SELECT *, CASE WHEN try_cast(ratedPowerKw AS DOUBLE) > 0 THEN try_cast(ratedPowerKw AS DOUBLE) END AS kw, CASE WHEN try_cast(ratedSpeedRpm AS DOUBLE) > 0 THEN try_cast(ratedSpeedRpm AS DOUBLE) END AS rpm,
    CASE WHEN equipmentClass IN ('EM', 'EG', 'servoMotor') THEN try_cast(shaftHeightMm AS DOUBLE) END AS shaft, equipmentClass = 'PU' OR (equipmentClass = '' AND pumpCategory <> '') AS pump,
    (equipmentClass || '-' || equipmentType) IN ('CO-SC', 'BL-rotaryPD', 'PU-RE', 'EG-MD', 'CO-RE') OR equipmentClass IN ('CE', 'CF') AS other_standard,
    equipmentClass IN ('TE', 'other') AS not_covered, driverClass = 'CE' AS engine, driverClass = 'CO,EM' AS recip FROM machines),
  g AS (SELECT *, CASE WHEN shaft >= 315 THEN 'group1' WHEN shaft >= 160 THEN 'group2' WHEN kw > 300 THEN 'group1' WHEN kw IS NOT NULL THEN 'group2' END AS grp,
    CASE WHEN pump THEN engine ELSE engine OR recip END AS coupled FROM m),
  r AS (SELECT *, CASE WHEN equipmentType <> '' AND equipmentClass = '' THEN 'type without class'
    WHEN equipmentType <> '' AND (equipmentClass || '-' || equipmentType) NOT IN ('EM-AC', 'PU-CE', 'BL-rotaryPD', 'CO-SC', 'GT-IN', 'servoMotor-DC', 'CE-DE', 'EG-MD') AND equipmentClass <> 'XX' THEN 'unknown type'
    WHEN pumpCategory <> '' AND equipmentClass NOT IN ('', 'PU') THEN 'pump category of another class' WHEN vel_is_rms <> 'true' THEN 'velocity is not RMS' WHEN equipmentClass = 'XX' THEN 'no_standard: class'
    WHEN other_standard OR not_covered THEN 'no_standard: excluded' WHEN coupled THEN 'no_standard: coupled to a reciprocating machine'
    WHEN pump AND pumpCategory = '' THEN 'pump category missing' WHEN pump AND kw IS NULL THEN 'pump power missing' WHEN pump AND kw <= 1 THEN 'no_standard: pump power' WHEN pump THEN NULL
    WHEN equipmentClass = 'GT' AND kw > 3000 THEN 'no_standard: large gas turbine' WHEN equipmentClass = 'BL' AND supportClass = 'flexible' AND kw <= 300 THEN 'no_standard: flexible fan'
    WHEN kw <= 15 OR kw > 50000 THEN 'no_standard: power' WHEN rpm < 120 OR rpm > 15000 THEN 'no_standard: speed' WHEN grp IS NULL THEN 'group unknown' WHEN supportClass = '' THEN 'support missing' END AS reason FROM g)"""


@query(_GRADING + " SELECT machine, reason AS grading_reason, grp AS machine_group FROM r")
def grading(spark, d):
    m = machines(spark, d)
    return m.select("machine", rules.grading_reason().alias("grading_reason"), rules.machine_group().alias("machine_group"))


@query(
    _GRADING
    + """, s AS (SELECT *, try_cast(limitAttention AS DOUBLE) < try_cast(limitWarning AS DOUBLE) AND try_cast(limitWarning AS DOUBLE) < try_cast(limitDanger AS DOUBLE) AS custom,
    coalesce(kw <= 15 AND equipmentClass NOT IN ('XX', 'BL') AND NOT other_standard AND NOT coupled, false) AS small FROM r)
  SELECT machine, CASE WHEN reason IS NULL THEN 'standard' WHEN reason LIKE 'no_standard%' AND custom THEN 'custom' WHEN reason LIKE 'no_standard%' AND limitAttention = '' AND small THEN 'small_machine' END AS source,
  CASE WHEN reason IS NULL AND pump THEN CASE WHEN pumpCategory = 'category1' THEN CASE WHEN kw <= 200 THEN 2.5 ELSE 3.5 END ELSE CASE WHEN kw <= 200 THEN 3.2 ELSE 4.2 END END
    WHEN reason IS NULL THEN CASE grp || supportClass WHEN 'group1rigid' THEN 2.3 WHEN 'group1flexible' THEN 3.5 WHEN 'group2rigid' THEN 1.4 ELSE 2.3 END
    WHEN reason LIKE 'no_standard%' AND custom THEN 1.0 WHEN reason LIKE 'no_standard%' AND limitAttention = '' AND small THEN 0.71 END AS first_limit FROM s"""
)
def grading_basis(spark, d):
    m = machines(spark, d).withColumn("grading_reason", rules.grading_reason())
    return rules.with_basis(m).select("machine", "source", F.get("limits", 0).cast("double").alias("first_limit"))


@query(
    f"""WITH {MACHINES_SQL} SELECT machine, CASE WHEN ratedSpeedRpm = '' THEN 'speed missing' WHEN CAST(ratedSpeedRpm AS DOUBLE) < 600 THEN 'low speed' END AS note,
    CASE WHEN shaftHeightMm = '' THEN 'unjudged' WHEN machine % 97 * 4 < CAST(shaftHeightMm AS DOUBLE) THEN 'stopped' ELSE 'running' END AS state FROM machines"""
)
def run_state(spark, d):
    m = machines(spark, d)
    return m.select("machine", rules.low_speed_note(F.col("ratedSpeedRpm")).alias("note"), rules.run_state((F.col("machine") % 97 * 4).cast("double"), F.col("shaftHeightMm")).alias("state"))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY binding, window_start, role ORDER BY t DESC, seq DESC) AS k FROM good WHERE role IN ('x_vel', 'y_vel')),
    e AS (SELECT binding, window_start, role, count(*) AS got, count(v) AS ok FROM r WHERE k <= 2 GROUP BY ALL),
    f AS (SELECT DISTINCT binding, window_start FROM good), a AS (SELECT f.binding, f.window_start, count(role) AS seen, min(CASE WHEN got < 2 THEN role || ': short' WHEN ok < 2 THEN role || ': bad' END) AS bad FROM f LEFT JOIN e USING (binding, window_start) GROUP BY ALL)
    SELECT binding, window_start, CASE WHEN seen = 0 THEN 'no_input' WHEN seen < 2 OR bad IS NOT NULL THEN 'insufficient_samples' ELSE 'ok' END AS quality, CASE WHEN seen = 0 THEN 'no channel' WHEN bad IS NOT NULL THEN bad WHEN seen < 2 THEN 'channel missing' END AS reason FROM a"""
)
def tail_n(spark, d):
    return plain_times(frames.tail_n(frames.frames(samples(spark, d), DAY), 2, ["x_vel", "y_vel"]).select("binding", "window_start", "quality", "reason"))


@query(f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY binding, window_start ORDER BY t DESC, seq DESC) AS k FROM good) SELECT binding, window_start, t, value FROM r WHERE k = 1""")
def latest_event(spark, d):
    return plain_times(frames.latest_event(frames.frames(samples(spark, d), DAY), ["binding", "window_start"]).select("binding", "window_start", "t", "value"))


@query(
    f"""WITH {SAMPLES}, {ANNOTATIONS}, w AS (SELECT annotation_id, binding, label, t_from, t_from + to_days(CAST(k AS INTEGER)) AS window_start, k = 2 AS closed FROM annotations CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE annotation_id % 20 < 20),
    m AS (SELECT w.label, w.annotation_id, w.window_start AS ws, count(s.seq) AS n, max(s.v) AS top FROM w LEFT JOIN good s ON s.binding = w.binding AND s.t >= w.window_start AND (s.t < w.window_start + INTERVAL 1 DAY OR (w.closed AND s.t = w.window_start + INTERVAL 1 DAY)) GROUP BY ALL)
    SELECT label, count(*) AS windows, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS empty_windows, sum(n)::BIGINT AS n_samples, max(top) AS top FROM m GROUP BY label"""
)
def split_windows(spark, d):
    w = frames.split_span(annotations(spark, d), DAY).select("annotation_id", "binding", "label", "window_start", "window_end", "closed")
    s = samples(spark, d).withColumn("v", frames.good_value()).select("binding", "t", "seq", "v")
    each = frames.aggregated_in_windows(w, s, [F.count("seq").alias("n"), F.max("v").alias("top")]).withColumn("n", F.coalesce("n", F.lit(0)))
    return each.groupBy("label").agg(F.count("*").alias("windows"), F.count_if(F.col("n") == 0).alias("empty_windows"), F.sum("n").alias("n_samples"), F.max("top").alias("top"))


@query(
    f"""WITH {SAMPLES}, {ANNOTATIONS}, w AS (SELECT annotation_id, binding, t_from + to_days(CAST(k AS INTEGER)) AS window_start, k = 2 AS closed FROM annotations CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE label LIKE '1%' AND data_origin = 'field' AND binding = 7)
    SELECT annotation_id, w.window_start, s.seq FROM w LEFT JOIN good s ON s.binding = w.binding AND s.role = 'temp' AND s.t >= w.window_start AND (s.t < w.window_start + INTERVAL 1 DAY OR (w.closed AND s.t = w.window_start + INTERVAL 1 DAY))"""
)
def windows_of_one_machine(spark, d):
    """The temperature samples of the urgent field labels of one machine, window by window; empty windows stay."""
    a = annotations(spark, d).where("label LIKE '1%' AND data_origin = 'field' AND binding = 7")
    w = frames.split_span(a, DAY).select("annotation_id", "binding", "window_start", "window_end", "closed")
    s = samples(spark, d).where("role = 'temp'").select("binding", "t", "seq")
    return plain_times(frames.samples_in_windows(w, s).select("annotation_id", "window_start", "seq"))


@query(f"""WITH {SAMPLES} SELECT binding, date_trunc('day', t + INTERVAL 2 HOUR) AS window_start, count(*) AS n, max(v) AS top FROM good GROUP BY 1, 2""")
def right_margin(spark, d):
    """Days that close two hours early, so that late values are in the next."""
    f = frames.frames(samples(spark, d).withColumn("v", frames.good_value()), DAY, margin_s=7200)
    return plain_times(f.groupBy("binding", "window_start").agg(F.count("*").alias("n"), F.max("v").alias("top")))


@query(f"""WITH {SAMPLES}, roles AS (SELECT s_suppkey AS tag_id, s_nationkey AS machine, CASE s_suppkey % 3 WHEN 0 THEN 'x_vel' WHEN 1 THEN 'y_vel' ELSE 'temp' END AS fed FROM supplier)
    SELECT machine, fed, count(*) AS n, round(sum(value), 4) AS total FROM samples JOIN roles USING (tag_id) GROUP BY machine, fed""")
def with_roles(spark, d):
    """Samples under the roles that their points feed."""
    pick = F.when(F.col("s_suppkey") % 3 == 0, "x_vel").when(F.col("s_suppkey") % 3 == 1, "y_vel").otherwise("temp")
    roles = table(spark, d, "supplier").select(F.col("s_nationkey").alias("binding"), pick.alias("role"), F.col("s_suppkey").alias("tag_id"))
    out = frames.with_roles(samples(spark, d).drop("binding", "role"), roles)
    return out.groupBy(F.col("binding").alias("machine"), F.col("role").alias("fed")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""WITH {ANNOTATIONS}, g AS (SELECT binding, sum(72)::BIGINT AS frames, count(*) AS samples FROM annotations GROUP BY binding)
    SELECT *, CASE WHEN samples > 20000 THEN 'too many samples' WHEN frames > 5000 THEN 'too many frames' END AS refused FROM g"""
)
def frame_gate(spark, d):
    return frames.frame_gate(annotations(spark, d), 3600, ["binding"])


@query(
    f"""WITH {SAMPLES}, p AS (SELECT c_custkey AS tag_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) SELECT tag_id, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM samples SEMI JOIN p USING (tag_id) WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20' GROUP BY tag_id"""
)
def read_range(spark, d):
    s = samples(spark, d)
    p = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("tag_id"))
    out = src.read_range(s, p, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return plain_times(out.groupBy("tag_id").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")))


@query(
    f"""WITH {SAMPLES}, h AS (SELECT tag_id, date_trunc('hour', t) AS t, value, status_code FROM samples), g AS (SELECT *, status_code > 0 AS good, bool_or(status_code > 0) OVER (PARTITION BY tag_id, t) AS any_good FROM h)
    SELECT tag_id, sum(CASE WHEN NOT good AND any_good THEN 1 ELSE 0 END)::BIGINT AS edges, sum(CASE WHEN NOT good AND any_good THEN 0 ELSE 1 END)::BIGINT AS kept FROM g GROUP BY tag_id"""
)
def outage_markers(spark, d):
    kept, edges = src.split_outage_markers(samples(spark, d).withColumn("t", F.date_trunc("hour", "t")))
    both = kept.select("tag_id", F.lit(0).alias("e")).union(edges.select("tag_id", F.lit(1).alias("e")))
    return both.groupBy("tag_id").agg(F.sum("e").alias("edges"), F.count_if(F.col("e") == 0).alias("kept"))


@query(
    """SELECT CASE l_linenumber WHEN 1 THEN 'quantity' WHEN 2 THEN 'price' ELSE 'none' END AS role, CASE WHEN l_linenumber <= 2 AND l_suppkey % 7 <> 0 THEN 'ok' ELSE 'input_bad' END AS quality, count(*) AS n,
    round(sum(CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber = 2 THEN l_extendedprice END), 2) AS total FROM lineitem GROUP BY 1, 2"""
)
def struct_fields(spark, d):
    li = table(spark, d, "lineitem")
    gap = F.col("l_suppkey") % 7 == 0
    v = li.select(
        F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).otherwise(3).cast("long").alias("tag_id"), F.col("l_shipdate").alias("t"), F.lit(1).alias("struct_id"), F.lit(1).alias("version"),
        F.create_map(F.lit(1), F.when(~gap, F.col("l_quantity")), F.lit(2), F.when(~gap, F.col("l_extendedprice"))).alias("numbers"),
    )
    roles = spark.createDataFrame([(1, "quantity", 1, 1, "price"), (1, "price", 2, None, "price"), (1, "none", 3, None, "missing")], "binding long, role string, tag_id long, field_number int, field_name string")
    fields = spark.createDataFrame([(1, 1, 1, "quantity"), (1, 1, 2, "price")], "struct_id int, version int, number int, name string")
    return src.project_struct_fields(v, roles, fields).groupBy("role", "quality").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query()
def decode_structs(spark, d):
    e = table(spark, d, "events")
    kinds = F.element_at(F.array(*map(F.lit, src.DTYPES)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = e.select("event_id", F.lit(1).alias("struct_id"), F.lit(1).alias("version"), (F.col("event_id") % 10).cast("int").alias("number"), F.encode("props", "utf-8").alias("payload"))
    fields = spark.range(10).select(F.lit(1).alias("struct_id"), F.lit(1).alias("version"), F.col("id").cast("int").alias("number"), F.element_at(F.array(*map(F.lit, src.DTYPES)), (F.col("id") + 1).cast("int")).alias("dtype"), (F.col("id") % 2 == 0).alias("big_endian"))
    out = src.decode_structs(rows, fields)
    return out.groupBy(kinds.alias("dtype")).agg(F.count("*").alias("n"), F.count("values").alias("whole"), F.sum(F.coalesce(F.size("values"), F.lit(0))).alias("items"))


@query(
    f"""WITH {PEAKS}, f AS (SELECT binding, window_start, zone, peak FROM zoned WHERE window_start >= TIMESTAMP '2024-01-10' AND window_start < TIMESTAMP '2024-01-15')
    SELECT key, count(*) AS n, count(value) AS n_numbers, round(sum(value), 4) AS total FROM (SELECT 'status' AS key, CAST(NULL AS DOUBLE) AS value FROM f UNION ALL SELECT 'zone', NULL FROM f UNION ALL SELECT 'vel_radial', peak FROM f UNION ALL
    SELECT 'margin', CASE WHEN peak <= l[1] THEN l[1] - peak WHEN peak <= l[2] THEN l[2] - peak ELSE l[3] - peak END FROM (SELECT *, CASE binding % 2 WHEN 0 THEN [10.0, 20.0, 30.0] ELSE [15.0, 30.0, 40.0] END AS l FROM f)) GROUP BY key"""
)
def replay_findings(spark, d):
    day = lambda s: F.lit(s).cast("timestamp")
    g = diagnosis.replay(samples(spark, d), _machine_dimension(spark, d), (day("2024-01-10"), day("2024-01-15")), DAY)
    return diagnosis.to_findings(g).groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("n_numbers"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH s AS (SELECT o_orderpriority AS label, o_custkey AS sample_id FROM orders), e AS (SELECT label, count(*) AS n, count(DISTINCT sample_id) AS k FROM s GROUP BY label) SELECT 1 AS job, count(*) AS classes, CASE WHEN count(*) < 2 THEN 'one class' WHEN min(n) < 10 THEN 'few frames' WHEN min(k) < 2 THEN 'few samples' END AS reason FROM e"""
)
def class_gates(spark, d):
    s = table(spark, d, "orders").select(F.lit(1).alias("job"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("sample_id"))
    return evaluation.class_gates(s, ["job"])


@query(
    f"""WITH {PEAKS}, f AS (SELECT binding, unnest(['status', 'zone', 'vel_radial', 'margin']) AS key, peak, zone, n_good FROM zoned)
    SELECT key, CASE WHEN zone IS NOT NULL THEN 'ok' WHEN n_good > 0 THEN 'insufficient_samples' ELSE 'input_bad' END AS quality, CAST(NULL AS VARCHAR) AS violation, count(*) AS n, round(sum(CASE WHEN key = 'vel_radial' THEN peak END), 4) AS total FROM f GROUP BY 1, 2"""
)
def module_findings(spark, d):
    """Findings of the declared vibration module, checked against its declaration."""
    from . import declarations

    f = declarations.plan(declarations.vibration(86400), samples(spark, d), {"machines": _machine_dimension(spark, d)})
    return f.groupBy("key", "quality", "violation").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("key") == "vel_radial", F.col("value"))), 4).alias("total"))


_SETTINGS = """c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS none, ['classic', 'baseline', 'both', '', 'all'][1 + c_custkey % 5] AS algorithms, ['true', 'false', '', 'yes'][1 + c_nationkey % 4] AS fault FROM customer)"""


def _bindings(spark, d):
    """Bindings of customers to the vibration module, many of them wrong in some way."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    pick = lambda by, *xs: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    role = lambda name, when: F.when(when, F.create_map(F.lit(name), k)).otherwise(F.create_map().cast("map<string,bigint>"))
    roles = F.map_concat(role("x_vel", k % 3 > 0), role("y_vel", k % 6 > 0), role("noise", k % 10 == 0))
    params = F.map_concat(
        F.create_map(F.lit("algorithms"), pick(k, "classic", "baseline", "both", "", "all"), F.lit("fault_classify"), pick(F.col("c_nationkey"), "true", "false", "", "yes"), F.lit("ratedPowerKw"), pick(k, "50", "-1", "x", "")),
        F.when(k % 11 == 0, F.create_map(F.lit("axialaxis"), F.lit("z"), F.lit("supportClass"), F.lit("soft"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    number = F.when(k % 7 == 0, F.create_map(F.lit("z_vel"), F.lit(3))).when(k % 7 == 1, F.create_map(F.lit("y_vel"), F.lit(0))).otherwise(F.create_map().cast("map<string,int>"))
    delay = F.when(k % 13 == 0, F.lit(-1)).when(k % 13 == 1, F.lit(4294967296)).when(k % 13 == 2, F.lit(None)).otherwise(F.lit(4294967295)).cast("long")
    return c.select(F.lit("vibration").alias("domain"), k.alias("binding"), roles.alias("roles"), params.alias("params"), number.alias("field_numbers"), delay.alias("delay_s"), F.lit(60).alias("window_s"), F.lit(60).alias("interval_s"))


@query(
    f"""WITH {_SETTINGS}, r AS (SELECT k, unnest([CASE WHEN k = 0 THEN 'point id not positive' END, CASE WHEN k % 6 = 0 AND k % 10 > 0 THEN 'no role' END, CASE WHEN k % 7 = 0 OR (k % 7 = 1 AND k % 6 = 0) THEN 'field number without point' END, CASE WHEN k % 7 = 1 THEN 'field number not positive' END,
      CASE WHEN k % 13 < 3 THEN 'delay out of range' END, CASE WHEN k % 3 = 0 THEN 'role not bound: x_vel' END, CASE WHEN k % 6 = 0 THEN 'role not bound: y_vel' END, CASE WHEN k % 10 = 0 THEN 'role not declared: noise' END,
      CASE WHEN k % 4 = 1 THEN 'ratedPowerKw: under least' WHEN k % 4 = 2 THEN 'ratedPowerKw: no float' END, CASE WHEN fault = 'yes' THEN 'fault_classify: no bool' END, CASE WHEN k % 11 = 0 THEN 'axialaxis: not declared' END, CASE WHEN k % 11 = 0 THEN 'supportClass: no choice' END]) AS problem FROM c)
    SELECT k AS binding, problem FROM r WHERE problem IS NOT NULL"""
)
def binding_problems(spark, d):
    from . import declarations

    return declarations.binding_problems(_bindings(spark, d), declarations.tables(spark, [declarations.vibration()])).select("binding", "problem")


@query(
    f"""WITH {_SETTINGS}, n AS (SELECT k, unnest([CASE WHEN algorithms <> 'classic' THEN 'baseline' END, CASE WHEN fault IN ('true', 'yes') THEN 'classifier' END]) AS kind FROM c)
    SELECT k AS binding, kind FROM n WHERE kind IS NOT NULL AND NOT (kind = 'baseline' AND k % 2 = 0)"""
)
def missing_artifacts(spark, d):
    """Artifacts that bindings need by their settings and lack; every second one has a baseline of its own."""
    from . import declarations

    b = _bindings(spark, d)
    active = b.where("binding % 2 = 0").select("domain", F.col("binding").cast("string").alias("binding"), F.lit("baseline").alias("kind"))
    return declarations.missing_artifacts(b, declarations.vibration(), active)
