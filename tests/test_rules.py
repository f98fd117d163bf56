"""Grading rules at their boundaries."""

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import quality, rules

BASE = {
    "equipmentClass": "EM", "equipmentType": "AC", "supportClass": "rigid", "pumpCategory": "", "ratedPowerKw": "50", "ratedSpeedRpm": "1480", "shaftHeightMm": "", "vel_is_rms": "true",
    "driverClass": "", "driverType": "", "drivenClass": "", "drivenType": "", "pumpEnvironment": "", "limitAttention": "", "limitWarning": "", "limitDanger": "",
}


def graded(spark, *changes):
    rows = [tuple((BASE | c).values()) for c in changes]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in BASE)).coalesce(1).withColumn("grading_reason", rules.grading_reason())
    df = rules.with_basis(df).withColumn("group", rules.machine_group())
    return df.select("grading_reason", "group", "limits", "source", F.col("basis_reason").alias("reason")).collect()


@pytest.mark.parametrize("v, zone", [(1.4, "A"), (1.41, "B"), (2.8, "B"), (2.81, "C"), (4.5, "C"), (4.51, "D"), (None, None)])
def test_limit_belongs_to_better_zone(spark, v, zone):
    df = spark.createDataFrame([(v,)], "v double").select(rules.severity_zone(F.col("v"), F.array(F.lit(1.4), F.lit(2.8), F.lit(4.5))))
    assert df.first()[0] == zone


def test_base_case_is_group2_rigid(spark):
    (row,) = graded(spark, {})
    assert (row.grading_reason, row.group, row.limits, row.source) == (None, "group2", [1.4, 2.8, 4.5], "standard")


def test_reasons(spark):
    got = graded(
        spark, {"equipmentClass": ""}, {"equipmentType": "ZZ"}, {"vel_is_rms": "false"}, {"equipmentClass": "CO", "equipmentType": "SC"}, {"drivenClass": "EM,CO", "drivenType": "AC,RE"},
        {"drivenClass": "EM,CO", "drivenType": "RE"}, {"ratedPowerKw": "15"}, {"ratedSpeedRpm": "119"}, {"ratedPowerKw": ""}, {"supportClass": ""},
        {"equipmentClass": "PU", "equipmentType": "CE", "pumpCategory": "category1", "ratedPowerKw": "200"}, {"equipmentClass": "BL", "equipmentType": "", "supportClass": "flexible", "ratedPowerKw": "300"},
    )
    assert [r.grading_reason for r in got] == [
        "type without class", "unknown type", "velocity is not RMS", "no_standard: excluded", "no_standard: coupled to a reciprocating machine", None, "no_standard: power", "no_standard: speed",
        "group unknown", "support missing", None, "no_standard: flexible fan",
    ]
    assert got[10].limits == [2.5, 4.0, 6.6]


def test_shaft_height_wins_over_power(spark):
    got = graded(spark, {"shaftHeightMm": "315"}, {"shaftHeightMm": "160", "ratedPowerKw": "400"}, {"shaftHeightMm": "159", "ratedPowerKw": "400"})
    assert [r.group for r in got] == ["group1", "group2", "group1"]


def test_own_lines_and_small_machines(spark):
    lines = {"limitAttention": "1", "limitWarning": "2", "limitDanger": "3"}
    small = {"ratedPowerKw": "10"}
    got = graded(spark, small, small | lines, small | lines | {"limitDanger": "1"}, lines)
    assert [(r.source, r.reason) for r in got] == [("small_machine", None), ("custom", None), (None, "custom lines wrong"), ("standard", None)]


def test_direction_is_balanced_first(spark):
    rows = [(1.0, 1.0, 1.0, "z"), (1.0, 0.2, 0.6, "z"), (1.0, 0.2, 0.1, "z"), (0.0, 0.0, 1.0, "z"), (1.0, 1.0, 1.0, "")]
    df = spark.createDataFrame(rows, "x double, y double, z double, a string").coalesce(1)
    got = [r[0] for r in df.select(rules.direction_hint(*[F.col(c) for c in ("x", "y", "z", "a")])).collect()]
    assert got == ["loose", "misaligned", "unbalanced", "no radial vibration", None]


def test_status_combination(spark):
    rows = [("normal", None, "attention", None), (None, "config_incomplete", "normal", None), ("normal", None, None, "model_not_loaded"), (None, None, None, "no_input"), ("danger", None, "normal", None)]
    df = spark.createDataFrame(rows, "c string, cb string, o string, ob string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(rules.combine_status(*[F.col(c) for c in ("c", "cb", "o", "ob")])).collect()]
    assert got == [("attention", "ok"), (None, "config_incomplete"), ("normal", "ok"), (None, "no_input"), ("danger", "ok")]


def test_trusted_codes_only(spark):
    codes = [1, 5000, 5004, 0, 2, -1000, -1002, -1004, -1007, None]
    df = spark.createDataFrame([(c,) for c in codes], "c int").coalesce(1)
    assert [r[0] for r in df.select(quality.trusted(F.col("c"))).collect()] == [True] * 3 + [False] * 7


def test_non_finite_is_null_never_zero(spark):
    rows = [("1.5",), ("NaN",), ("Infinity",), ("true",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "s string").coalesce(1)
    assert [r[0] for r in df.select(quality.numeric_only(F.col("s"))).collect()] == [1.5, None, None, None, None, None]
