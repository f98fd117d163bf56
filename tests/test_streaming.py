"""Streaming operators against their batch twins."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tremorlake.streaming import alarms, beats

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_one_second_delay_on_a_sixty_second_series(spark):
    """An alarm carries the time at which its condition began, not when the delay was over."""
    rows = [(1, at(60 * i), i, v) for i, v in enumerate([0.0, 5.0, 5.0, 0.0, 5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "tag_id long, t timestamp, seq long, value double")
    got = alarms.debounced(df, F.col("value") >= 3, ["tag_id"], 1, 0).orderBy("t").collect()
    assert [(r.kind, r.t.minute) for r in got] == [("raised", 1), ("cleared", 3), ("raised", 4), ("cleared", 5)]
    longer = alarms.debounced(df, F.col("value") >= 3, ["tag_id"], 90, 0).orderBy("t").collect()
    assert [(r.kind, r.t.minute) for r in longer] == [("raised", 1), ("cleared", 3)]


def test_hysteresis_is_one_sided(spark):
    rows = [(1, at(i), i, v) for i, v in enumerate([4.5, 5.0, 4.5, 4.0, 4.5, 5.0])]
    df = spark.createDataFrame(rows, "tag_id long, t timestamp, seq long, value double")
    got = alarms.hysteresis(df, F.lit(5.0), F.lit(1.0), ["tag_id"]).orderBy("seq").collect()
    assert [r.active for r in got] == [False, True, True, False, False, True]


def test_last_version_of_a_revisable_value(spark):
    path = tempfile.mkdtemp(prefix="spark-upsert-", dir="/tmp") + "/t"
    for batch, v in ((0, 1.0), (1, 2.0), (1, 3.0)):
        beats.upsert(spark.createDataFrame([(1, at(0), v)], "tag_id long, t timestamp, value double"), batch, path)
    assert beats.latest(spark.read.parquet(path)).first().value == 3.0
