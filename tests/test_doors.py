"""Swinging doors against the plain loop, however series are cut."""

import collections
import datetime as dt
import math
import random

import numpy as np
import pytest

from test_stateful import SAMPLE, Stream, cut
from tremorlake.streaming import doors

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)


def plain(rows, error):
    """The loop over a whole series: (t, seq) of what it keeps."""
    rows = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[2]))
    if not rows:
        return []
    sec = lambda r: (r[1] - T0).total_seconds()
    kept, at, last = [rows[0]], rows[0], rows[0]
    high, low = math.inf, -math.inf
    for r in rows[1:]:
        d = max(sec(r) - sec(at), 1e-9)
        high, low = min(high, (r[3] + error - at[3]) / d), max(low, (r[3] - error - at[3]) / d)
        if low > high:
            kept.append(last)
            at, d = last, max(sec(r) - sec(last), 1e-9)
            high, low = (r[3] + error - at[3]) / d, (r[3] - error - at[3]) / d
        last = r
    return [(r[0], r[1].replace(tzinfo=None), r[2]) for r in kept + ([last] if last is not rows[0] else [])]


def series(days=6, step=3600):
    rng = random.Random(7)
    n, out = days * 86400 // step, []
    walk_ = 0.0
    for i in range(n):
        t = T0 + dt.timedelta(seconds=step * i + rng.randrange(600))
        walk_ += rng.gauss(0, 1)
        shapes = {1: 5.0, 2: 0.01 * i, 3: walk_, 4: 10 * math.sin(i / 20), 5: float(rng.randrange(2) * 10), 6: 5.0 if i < n - 3 else 50.0, 7: 0.001 * i * i}
        out += [(k, t, i, v) for k, v in shapes.items()]
        if i % 9 == 0:
            out += [(3, t, i + 100_000, walk_ + 3), (4, t + dt.timedelta(seconds=1), i + 100_000, None)]
    return out + [(8, T0, 0, 1.0), (9, T0, 0, None)]


def by_key(rows, error):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return sorted(x for g in groups.values() for x in plain(g, error))


@pytest.mark.parametrize(("error", "block_s"), [(0.5, 86400), (2.0, 20_000), (0.05, 86400)])
def test_blocks_do_not_show(spark, error, block_s):
    rows = series()
    got = doors.swinging_door(spark.createDataFrame(rows, SAMPLE), ["key"], error, block_s)
    assert sorted((r.key, r.t, r.seq) for r in got.collect()) == by_key(rows, error)
    assert got.columns == ["key", "t", "seq", "value"]


def test_one_pass_over_series_keeps_the_same(spark):
    rows = series()
    got = doors.swinging_door_by_series(spark.createDataFrame(rows, SAMPLE), ["key"], 0.5)
    assert sorted((r.key, r.t, r.seq) for r in got.collect()) == by_key(rows, 0.5)


def test_empty_tables_and_corners(spark):
    none = spark.createDataFrame([], SAMPLE)
    assert doors.swinging_door(none, ["key"], 1.0).count() == 0
    rows = [(1, T0 + dt.timedelta(seconds=i), i, float(v)) for i, v in enumerate([0, 1, 2, 3, 4, 3, 2, 1, 0])]
    got = doors.swinging_door(spark.createDataFrame(rows, SAMPLE), ["key"], 0.01, 3).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 4, 8]


def test_stream_keeps_the_same(spark):
    rows = sorted(series(3), key=lambda r: r[1])
    s = Stream(spark, SAMPLE)
    for part in cut(rows, [100, 1, 150]):
        s.add(part)
    got = s.run(lambda x: doors.swinging_door_stream(x, 1.0, delay_s=2, forget_s=86400))
    s.add([(0, T0 + dt.timedelta(days=9), 0, 1.0)])
    got = s.run(lambda x: doors.swinging_door_stream(x, 1.0, delay_s=2, forget_s=86400))
    assert sorted((r.key, r.t, r.seq) for r in got.where("key > 0").collect()) == by_key(rows, 1.0)


def test_hull_holds_the_least_slope():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = np.sort(rng.random(40)) + 1
        y = rng.normal(size=40)
        h = doors.hull(x, y)
        for p in rng.normal(size=5):
            assert np.isclose(((y[h] - p) / x[h]).min(), ((y - p) / x).min())
