"""Sources, sinks and tables on small inputs."""

import datetime as dt
import struct
import tempfile

from pyspark.sql import functions as F

from tremorlake.operators import frames, labels, models, vision
from tremorlake.sources import samples as src
from tremorlake.sources import sinks

T0 = dt.datetime(2026, 9, 10, 12, tzinfo=dt.timezone.utc)


def test_wave_csv_with_either_separator(spark):
    path = tempfile.mkdtemp(prefix="spark-csv-", dir="/tmp")
    with open(f"{path}/a.csv", "w") as f:
        f.write("9,39,39,65664,0.552,-0.146\n9,39,39,1.6562e+005,0.1,0.2\nshort,1\n")
    with open(f"{path}/b.csv", "w") as f:
        f.write("9;39;39;65664;0.552;-0.146\n")
    rows = src.read_wave_csv(spark, path).collect()
    assert len(rows) == 3 and {r.us for r in rows} == {65664.0, 165620.0}


def test_decoding_of_buffers(spark):
    rows = [(1, 1, 1, struct.pack("<3f", 1, 2, 3)), (1, 1, 2, struct.pack(">2h", 1, -2)), (1, 1, 1, b"123"), (1, 1, 9, b"1234"), (1, 1, 1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, struct_id int, version int, number int, payload binary")
    fields = spark.createDataFrame([(1, 1, 1, "f4", False), (1, 1, 2, "i2", True)], "struct_id int, version int, number int, dtype string, big_endian boolean")
    got = {r.i: r["values"] for r in src.decode_structs(df, fields).collect()}
    assert got == {0: [1.0, 2.0, 3.0], 1: [1.0, -2.0], 2: None, 3: None, 4: None}


def test_capture_time_needs_a_zone(spark):
    raw = ["2026-09-10T12:00:00Z", "2026-09-10T12:00:00+08:00", "2026-09-10T12:00:00", "x", None]
    df = spark.createDataFrame([(r,) for r in raw], "s string").coalesce(1)
    assert [r[0] is None for r in df.select(src.iso_captured_at(F.col("s"))).collect()] == [False, False, True, True, True]


def test_media_gap_is_not_nearest(spark):
    media = spark.createDataFrame([(1, 10, T0, 60.0), (1, 11, T0 + dt.timedelta(hours=2), 0.0)], "tag_id long, media_id long, start timestamp, seconds double")
    asked = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=s)) for s in (0, 59, 60, 7200)], "tag_id long, t timestamp")
    got = [r.media_id for r in src.media_at(media, asked).orderBy("t").collect()]
    assert got == [10, 10, None, 11]


def test_point_ids_are_never_reused(spark):
    known = spark.createDataFrame([("a", 7)], "key string, point_id long")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "key string")
    got = sinks.allocate_point_ids(new, known, ["key"], spark.createDataFrame([(9,)], "point_id long")).collect()
    assert sorted(r.point_id for r in got) == [10, 11] and {r.key for r in got} == {"b", "c"}


def test_rewriting_a_day_leaves_one_copy(spark):
    path = tempfile.mkdtemp(prefix="spark-sink-", dir="/tmp") + "/f"
    rows = spark.createDataFrame([(1, T0, 1.0, "ok"), (2, T0, None, "no_input"), (3, T0, None, "ok")], "point_id long, t timestamp, value double, quality string")
    for _ in range(2):
        sinks.write_findings(rows, path)
    got = {r.point_id: (r.value, r.status_code) for r in spark.read.parquet(path).collect()}
    assert got == {1: (1.0, 1), 2: (None, -1002)} and spark.read.parquet(path).count() == 2


def test_last_window_of_a_span_takes_its_end(spark):
    span = spark.createDataFrame([(1, T0, T0 + dt.timedelta(seconds=125))], "binding long, t_from timestamp, t_to timestamp")
    w = frames.split_span(span, 60)
    s = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=x), x) for x in (0, 59, 60, 120, 121)], "binding long, t timestamp, seq long")
    got = frames.samples_in_windows(w.select("binding", "window_start", "window_end", "closed"), s).groupBy("window_start").agg(F.count("seq").alias("n")).orderBy("window_start").collect()
    assert [r.n for r in got] == [2, 2]


def test_tail_is_never_filled(spark):
    rows = [("m", role, T0 + dt.timedelta(seconds=i), i, float(i), code) for role in ("a", "b") for i, code in enumerate([5000, 5000, 5000 if role == "a" else -1000])]
    df = spark.createDataFrame(rows, "binding string, role string, t timestamp, seq long, value double, status_code int").withColumn("window_start", F.lit(T0)).withColumn("window_end", F.lit(T0))
    assert frames.tail_n(df, 2, ["a"], 1.0).first().tail["a"] == [1.0, 2.0]
    assert frames.tail_n(df, 2, ["a", "b"]).first().reason == "b: bad"
    assert frames.tail_n(df, 4, ["a"]).first().reason == "a: short"
    assert frames.tail_n(df, 2, ["a"], 5.0).first().reason == "a: spacing"
    assert frames.tail_n(df, 2, ["z"]).first().quality == "no_input"


def test_suppression_keeps_overlap_at_the_threshold(spark):
    rows = [(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 3, 1, 0.7, 0.0, 0.0, 10.0, 10.0), (1, 4, 0, 0.55, 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.det_id for r in vision.non_max_suppression(df).collect()) == [1, 3]


def test_press_features_and_resampling(spark):
    p = [0.5 * i for i in range(40)]
    f = [10 + 5.0 * i for i in range(40)]
    df = spark.createDataFrame([(1, p, [1.0] * 40, f), (2, p, [1.0] * 40, f[:-3]), (3, None, None, None)], "id int, position array<double>, velocity array<double>, force array<double>")
    got = {r.id: r for r in models.resample_press(models.press_features(df), 8).collect()}
    assert (got[1].peak_force, got[1].stroke, got[1].quality) == (205.0, 19.5, "ok") and len(got[1].force_n) == 8
    assert got[2].quality == got[3].quality == "input_bad" and got[2].force_n is None


def test_origins_fold_to_the_strictest(spark):
    rows = [(1, "field"), (1, "field"), (2, "field"), (2, "simulated"), (3, "field"), (3, ""), (4, "")]
    df = spark.createDataFrame(rows, "k int, origin string")
    assert {r.k: r.origin for r in labels.fold_origin(df, ["k"]).collect()} == {1: "field", 2: "simulated", 3: "", 4: ""}
