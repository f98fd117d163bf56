"""Qualities of samples and findings as column expressions."""

from __future__ import annotations

import string
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

#: Status codes of input that may be used.
TRUSTED_CODES = (1, 5000, 5004)
#: Quality, status code written for it, whether it is a fault of the device, display, what to look at.
QUALITIES = (
    ("ok", 1, False, "normal", ""),
    ("input_bad", -1000, True, "bad input", "acquisition or sensor"),
    ("no_input", -1002, False, "no input", "acquisition: no data in that time"),
    ("model_not_loaded", -1034, False, "no active model or baseline", "activate a model or take a baseline"),
    ("config_incomplete", -1001, False, "configuration incomplete", "required parameters or points"),
    ("insufficient_samples", -1000, False, "too few samples", "beat and window length"),
    ("low_confidence", -1000, False, "low confidence", "the case may be outside the model"),
    ("compute_error", -1000, True, "computation failed", "report the module"),
)


def trusted(code: Column) -> Column:
    return F.coalesce(code.isin(*TRUSTED_CODES), F.lit(False))


def quality_of(code: Column) -> Column:
    return F.when(trusted(code), "ok").otherwise("input_bad")


def _lookup(quality: Column, at: int) -> Column:
    out = F.when(F.lit(False), F.lit(QUALITIES[0][at]))
    for row in QUALITIES:
        out = out.when(quality == row[0], F.lit(row[at]))
    return out


def status_code(quality: Column) -> Column:
    return _lookup(quality, 1)


def is_fault(quality: Column) -> Column:
    return _lookup(quality, 2)


def display(quality: Column) -> Column:
    return _lookup(quality, 3)


def hint(quality: Column) -> Column:
    return _lookup(quality, 4)


def whole_share(n: Column, share: float) -> Column:
    """The whole rows of n that a share is, by its decimal digits: 0.7 of 90 is 63, where doubles give less."""
    return F.floor(n.cast("long") * F.lit(Decimal(str(share)))).cast("long")


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite: never 0."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def numeric_only(v: Column) -> Column:
    """v as a number, or null where it is a truth value, no number, NaN or infinite."""
    return finite(v.try_cast("double"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def check_findings(findings: DataFrame) -> DataFrame:
    """findings (key, value, quality, t, ...) with value null where it may not be given, and violation, null if none."""
    v = F.col("value")
    good = F.col("quality") == "ok"
    bad_value = v.isNotNull() & finite(v).isNull()
    violation = (
        F.when(F.coalesce(F.trim("key"), F.lit("")) == "", "no key")
        .when(F.col("t").isNull(), "no time")
        .when(~F.coalesce(F.col("quality").isin(*[q[0] for q in QUALITIES]), F.lit(False)), "unknown quality")
        .when(good & finite(v).isNull(), "ok without a finite value")
    )
    return findings.withColumn("violation", violation).withColumn("value", F.when(bad_value, None).otherwise(v))


def keep_declared(findings: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (key, t, window_start, window_end) whose key is in outputs (key) and time in the window, and the rest."""
    known = findings.join(outputs.select("key").distinct().withColumn("declared", F.lit(True)), "key", "left")
    ok = F.coalesce(F.col("declared"), F.lit(False)) & F.col("t").between(F.col("window_start"), F.col("window_end"))
    ok = F.coalesce(ok, F.lit(False))
    return known.where(ok).drop("declared"), known.where(~ok).drop("declared")


def no_input_no_ok(findings: DataFrame, frames: DataFrame, frame: list[str]) -> DataFrame:
    """Findings of frames without trusted input may not be ok: they become input_bad, or no_input without samples.

    frames: samples with the frame's keys and status_code.
    """
    seen = frames.groupBy(*frame).agg(F.max(trusted(F.col("status_code"))).alias("any_good"), F.count("status_code").alias("n"))
    out = findings.join(seen, frame, "left")
    wrong = (F.col("quality") == "ok") & ~F.coalesce("any_good", F.lit(False))
    quality = F.when(wrong & (F.coalesce("n", F.lit(0)) > 0), "input_bad").when(wrong, "no_input").otherwise(F.col("quality"))
    return out.withColumn("value", F.when(~wrong, F.col("value"))).withColumn("quality", quality).drop("any_good", "n")


def anchor_all(frames: DataFrame, outputs: DataFrame, quality: str) -> DataFrame:
    """One bad row at the end of each frame for every output, of which there are a few."""
    return frames.crossJoin(F.broadcast(outputs.select("key"))).withColumn("value", F.lit(None).cast("double")).withColumn("quality", F.lit(quality)).withColumn("t", F.col("window_end"))
