"""Module declarations: what is refused, and what their plans and checks say; subscriptions and segments."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_stateful import Stream
from tremorlake.functions.signal import kurtosis_crest
from tremorlake.operators import segments
from tremorlake.plans import declarations as d
from tremorlake.streaming import beats

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)


def problems(inputs=(), outputs=(d.Output("a"),), **more):
    return d.Declaration(tuple(inputs), tuple(outputs), **more).problems()


def test_illegal_declarations_are_refused_with_all_reasons():
    assert d.vibration().declaration.problems() == [] and d.vibration(stop_below=1.0).declaration.problems() == []
    assert problems(outputs=()) == ["no outputs"]
    assert problems([d.Input("x"), d.Input("x")]) == ["input 'x' is declared twice"]
    assert problems([d.Input("x", quantity="q", axis="x"), d.Input("y", quantity="q", axis="x")]) == ["quantity and axis ('q', 'x') is declared twice"]
    assert problems([d.Input("x", kind="sound", axis="w"), d.Input("s", kind="struct", struct="curve")]) == ["input x: kind 'sound'", "input x: axis 'w'", "input s: struct 'curve' is not declared"]
    assert problems([d.Input("s", kind="struct", struct="curve")], structs=("curve",)) == []
    assert problems(outputs=[d.Output("a", "number", when_stopped="later"), d.Output("b", "string", when_stopped="literal")]) == ["output a: type 'number'", "output a: when stopped 'later'", "output b: a literal when stopped needs choices"]
    bad = [d.Output("s", "string", choices=("normal", "odd"), is_status=True), d.Output("t", "string", choices=("normal", "stopped"), is_status=True)]
    assert problems(outputs=bad) == ["more than one status", "output s: a status is text of normal, attention, warning, danger, stopped", "output t: stopped is a choice if and only if it is written when stopped"]
    params = [d.Param("p", "enum"), d.Param("q", "string", ("a",)), d.Param("r", "enum", ("a",), default="b"), d.Param("s", "bool", least=0), d.Param("t", "int", least=2, most=1)]
    assert [x.split(":")[0] for x in problems(params=tuple(params))] == ["param p", "param q", "param r", "param s", "param t"]
    with pytest.raises(ValueError, match="input 'x' is declared twice; no outputs"):
        d.Module("m", d.Declaration((d.Input("x"), d.Input("x")), ()), lambda s, x: s)


def _samples(spark):
    rows = [("m", r, T0 + dt.timedelta(seconds=i), i, v, 5000) for i, (r, v) in enumerate([("x_vel", 1.0), ("y_vel", 9.0), ("z_vel", 0.5), ("x_vel", 2.0)])]
    return spark.createDataFrame(rows, "binding string, role string, t timestamp, seq long, value double, status_code int")


def _dims(spark):
    return {"machines": spark.createDataFrame([("m", "z", [1.4, 2.8, 4.5], False)], "binding string, axial string, limits array<double>, custom boolean")}


def test_plans_are_checked_before_they_run(spark):
    out = d.plan(d.vibration(60), _samples(spark), _dims(spark)).collect()
    assert {r.key: (r.text, r.value) for r in out} == {"status": ("danger", None), "zone": ("D", None), "vel_radial": (None, 9.0), "margin": (None, -4.5)} and not any(r.violation for r in out)
    with pytest.raises(ValueError, match="input lacks status_code"):
        d.plan(d.vibration(60), _samples(spark).drop("status_code"), _dims(spark))
    with pytest.raises(ValueError, match="value is string, not double"):
        d.plan(d.vibration(60), _samples(spark).withColumn("value", F.col("value").cast("string")), _dims(spark))
    odd = lambda s, x: d.diagnosis.to_findings(d.diagnosis.graded_windows(s, x["machines"], 60)).drop("quality")
    with pytest.raises(ValueError, match="output lacks quality"):
        d.plan(d.Module("odd", d.vibration().declaration, odd), _samples(spark), _dims(spark))


def test_findings_that_break_the_declaration(spark):
    rows = [("m", "status", None, "normal", "ok"), ("m", "status", None, "fine", "ok"), ("m", "status", 1.0, "normal", "ok"), ("m", "margin", None, None, "ok"), ("m", "margin", None, None, "no_input"), ("m", "count", 1.5, None, "ok"), ("m", "count", 2.0, None, "ok"), ("m", "more", 1.0, None, "ok"), ("m", "margin", float("nan"), None, "ok")]
    f = spark.createDataFrame(rows, "binding string, key string, value double, text string, quality string").withColumn("t", F.lit(T0)).coalesce(1)
    outputs = (d.Output("status", "string", choices=("normal", "danger")), d.Output("margin"), d.Output("count", "int"))
    out = d.plan(d.Module("m", d.Declaration((), outputs), lambda s, x: f, requires={}), f, {})
    got = {(r.key, str(r.value), r.text, r.quality): r.violation for r in out.collect()}
    assert got == {
        ("status", "None", "normal", "ok"): None, ("status", "None", "fine", "ok"): "no choice", ("status", "1.0", "normal", "ok"): "no string", ("margin", "None", None, "ok"): "ok without a value", ("margin", "None", None, "no_input"): None,
        ("count", "1.5", None, "ok"): "no int", ("count", "2.0", None, "ok"): None, ("more", "1.0", None, "ok"): "not declared", ("margin", "nan", None, "ok"): "no float",
    }


def test_groups_are_bound_whole_or_not_at_all(spark):
    inputs = tuple(d.Input(r, required=False, group="second") for r in ("a", "b")) + (d.Input("img", kind="image"),)
    images = d.Module("images", d.Declaration((d.Input("img", kind="image"),), (d.Output("n"),)), lambda s, x: s)
    tables = d.tables(spark, [d.Module("m", d.Declaration(inputs, (d.Output("n"),)), lambda s, x: s), images])
    rows = [("m", 1, {"a": 1}), ("m", 2, {"a": 1, "b": 2}), ("m", 3, {}), ("images", 4, {})]
    b = spark.createDataFrame([(*r, {}, 60, 60) for r in rows], "domain string, binding long, roles map<string,long>, params map<string,string>, window_s int, interval_s int")
    assert {(r.binding, r.problem) for r in d.binding_problems(b, tables).collect()} == {(1, "half a group: second"), (3, "no role")}


def test_a_point_added_counts_from_the_next_batch(spark):
    s = Stream(spark, "tag_id long, t timestamp, seq long, value double, status_code int, struct_id int")
    point = lambda *tags: spark.createDataFrame([(t,) for t in tags], "tag_id long").coalesce(1).write.mode("append").parquet(f"{s.at}/points")
    rows = lambda k: [(tag, T0, k, 1.0, 5000, struct) for tag, struct in ((1, None), (2, 7), (3, 8))]
    point(1)
    spark.createDataFrame([(7,)], "struct_id int").write.parquet(f"{s.at}/structs")
    s.add(rows(0))
    source = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{s.at}/in/*")
    q = beats.subscription(source, f"{s.at}/points", f"{s.at}/out", f"{s.at}/state", f"{s.at}/structs").trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        point(2, 3, 1)
        s.add(rows(1))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.seq, r.tag_id, r.value, r.status_code) for r in spark.read.parquet(f"{s.at}/out").collect()}
    assert got == {(0, 1, 1.0, 5000), (1, 1, 1.0, 5000), (1, 2, 1.0, 5000), (1, 3, None, -1035)}


def test_a_long_record_is_many_tasks(spark):
    rng = np.random.default_rng(3)
    wave = rng.standard_normal(200_007)
    wave[100_000:] *= 1 + 5 * (rng.random(100_007) < 0.01)
    df = spark.createDataFrame([("r", 1, wave.tolist()), ("short", 1, [1.0] * 10), ("null", 1, None)], "record string, label int, wave array<double>")
    cut = segments.cut_records(df, 1000, 16)
    assert cut.select(F.spark_partition_id()).distinct().count() > 8 and cut.count() == 200
    k = cut.withColumn("kurt", kurtosis_crest(F.col("wave"))["kurt"])
    assert [r.kurt for r in k.orderBy("segment").collect()] == pytest.approx([((s - s.mean()) ** 4).mean() / s.var() ** 2 for s in wave[:200_000].reshape(200, 1000)])
    v = segments.record_verdicts(k, ["record", "label"], F.col("kurt") > 4).first()
    assert (v.segments, v.over_half) == (200, False) and 0.2 < v.share <= 0.5
    assert segments.class_verdicts(segments.record_verdicts(k.where("segment >= 100"), ["record", "label"], F.col("kurt") > 3.2), "label").first().over_half == 1.0
    long = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(wave[:5003])], "record string, i long, v double").repartition(5)
    got = {r.segment: r.wave for r in segments.segments_of_rows(long, ["record"], "i", "v", 1000).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[3] == wave[3000:4000].tolist()
