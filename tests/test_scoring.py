"""Scoring by tiny networks whose outputs show what they were given; wave files and buffers."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import rules
from tremorlake.operators import scoring
from tremorlake.sources import samples as src

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    """A field of a protocol message: an integer, or bytes, text or a message with its length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _value(name, *dims):
    shape = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def network(channels, points, *heads, first=True, batch="n"):
    """An ONNX file of linear heads on the flattened window: heads are matrices (channels * points, numbers)."""
    node = lambda kind, inputs, output: _field(1, b"".join(_field(1, x) for x in inputs) + _field(2, output) + _field(4, kind))
    graph = node("Flatten", ["x"], "flat")
    for k, w in enumerate(heads):
        graph += node("MatMul", ["flat", f"w{k}"], f"y{k}")
    graph += _field(2, "g")
    for k, w in enumerate(heads):
        w = np.asarray(w, np.float32)
        graph += _field(5, _field(1, w.shape[0]) + _field(1, w.shape[1]) + _field(2, 1) + _field(8, f"w{k}") + _field(9, w.tobytes()))
    graph += _field(11, _value("x", batch, channels, points) if first else _value("x", batch, points, channels))
    for k, w in enumerate(heads):
        graph += _field(12, _value(f"y{k}", batch, np.shape(w)[1]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def _last(channel, points, channels, column, columns):
    """A head that passes the last value of a channel to one of its outputs."""
    w = np.zeros((channels * points, columns))
    w[channel * points + points - 1, column] = 1
    return w


def tails(spark):
    rows = [
        (1, {"b": [1.0, 2.0, 5.0], "a": [0.0, 0.0, 1.0]}, "ok"), (2, {"b": [0.0, 0.0, -3.0], "a": [1.0, 1.0, 4.0]}, "ok"), (3, {"b": [1.0, 2.0, 3.0]}, "ok"), (4, None, "no_input"),
        (5, {"a": [1.0, 2.0], "b": [1.0, 2.0]}, "ok"), (6, {"a": [1.0, 2.0, None], "b": [1.0, 2.0, 3.0]}, "ok"), (7, {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0, 3.0, 4.0]}, "ok"),
    ]
    return spark.createDataFrame(rows, "i int, tail map<string,array<double>>, quality string")


def test_channels_in_the_network_s_own_order(spark):
    w = _last(0, 3, 2, 0, 2) + _last(1, 3, 2, 1, 2)
    for batch in ("n", 1):
        net = scoring.Network(network(2, 3, w, batch=batch), ("a", "b"), ("is a", "is b"))
        got = {r.i: r for r in scoring.score(tails(spark), net).collect()}
        assert [got[i]["class"] for i in range(1, 8)] == ["is b", "is a"] + [None] * 5
        assert [got[i].quality for i in range(1, 8)] == ["ok", "ok", "insufficient_samples", "no_input", "compute_error", "insufficient_samples", "insufficient_samples"]
        e = np.exp([1.0, 5.0])
        assert got[1].probability == pytest.approx(e[1] / e.sum())
    swapped = scoring.Network(network(2, 3, w), ("b", "a"), ("is b", "is a"))
    assert {r.i: r["class"] for r in scoring.score(tails(spark), swapped).where("i < 3").collect()} == {1: "is b", 2: "is a"}


def test_scaling_and_layout(spark):
    flat = np.zeros((6, 2))
    flat[4, 0], flat[5, 1] = 1, 1  # the last point of either channel, points first
    net = scoring.Network(network(2, 3, flat, first=False), ("a", "b"), ("x", "y"), scale=("zscore", (1.0, 2.0), (1.0, 3.0)), channels_first=False)
    x = np.array([[[0, 0, 1.0], [1, 2, 8.0]]])
    e = np.exp([(1 - 1) / 1, (8 - 2) / 3])
    assert np.allclose(scoring.predict(net, x)[0], e / e.sum())
    net = scoring.Network(network(2, 3, flat, first=False), ("a", "b"), ("x", "y"), scale=("minmax", (0.0, 1.0), (4.0, 5.0)), channels_first=False)
    assert np.allclose(scoring.predict(net, np.array([[[0, 0, 0.0], [1, 2, 5.0]]]))[0], [[0.0, 1.0]])  # probabilities already


def test_drives_tell_severities(spark):
    w = _last(0, 3, 2, 0, 6)
    now, later = _last(1, 3, 2, 0, 1) * 0.1, _last(1, 3, 2, 0, 3) * 0.2 + _last(1, 3, 2, 1, 3) * 0.3 + _last(1, 3, 2, 2, 3) * 0.4
    net = scoring.Network(network(2, 3, w, now, later), ("a", "b"), tuple("abcdef"), (("now",), ("p", "q", "r")))
    got = {r.i: r for r in scoring.score_drives(tails(spark), net).collect()}
    assert (got[1].fault_type, got[1].severity, got[1].severity_30s, got[1].severity_60s, got[1].severity_120s) == ("a", 0.5, 1.0, 1.5, 2.0)
    assert (got[4].fault_type, got[4].severity, got[4].severity_120s) == (None, None, None)
    with pytest.raises(ValueError):
        scoring.score_drives(tails(spark), scoring.Network(network(2, 3, w), ("a", "b"), tuple("abcdef")))


def test_contracts_are_checked_before_the_job(spark):
    good = network(2, 3, _last(0, 3, 2, 0, 2))
    assert scoring.Network(good, ("a", "b"), ("x", "y")).problems() == []
    assert scoring.Network(good, ("a", "a"), ("x", "y", "z")).problems() == ["channel 'a' twice", "output y0 has 2 numbers, not 3"]
    assert scoring.Network(good, ("a", "b"), ("x", "y"), (("s",),)).problems() == ["1 outputs for 2 heads"]
    assert scoring.Network(good, ("a", "b"), ("x", "y"), scale=("zscore", (0.0, 0.0), (1.0, 0.0))).problems() == ["scale without spread"]
    assert scoring.Network(good, ("a", "b"), ("x", "y"), scale=("log", (0.0,), (1.0,))).problems() == ["scale 'log'", "scale of another number of channels"]
    assert scoring.Network(b"junk", ("a",), ("x", "y")).problems()[0].startswith("no network")
    with pytest.raises(ValueError, match="twice"):
        scoring.score(tails(spark), scoring.Network(good, ("a", "a"), ("x", "y")))


def test_press_curves_from_records_to_verdicts(spark):
    p = [0.5 * i for i in range(40)]
    f = [10 + 5.0 * i for i in range(40)]
    rows = [(1, T0, p, [1.0] * 40, f), (2, T0 + dt.timedelta(seconds=7), p, [9.0] * 40, [-x for x in f]), (3, T0, p, [1.0] * 40, f[:-3]), (4, T0, [1.0] * 40, [1.0] * 40, f), (5, T0, None, None, None)]
    press = spark.createDataFrame(rows, "i int, t timestamp, position array<double>, velocity array<double>, force array<double>")
    w = (_last(0, 8, 2, 0, 4) + _last(1, 8, 2, 3, 4)) * 0.1
    net = scoring.Network(network(2, 8, w), ("force", "velocity"), ("too hard", "too soft", "late", "good"))
    got = {r.i: r for r in scoring.score_press_curves(press, net, 8).collect()}
    assert (got[1].verdict, got[1].peak_force, got[1].stroke, got[1].t) == ("too hard", 205.0, 19.5, T0.replace(tzinfo=None))
    assert (got[2].verdict, got[2].t) == ("good", (T0 + dt.timedelta(seconds=7)).replace(tzinfo=None))
    e = np.exp([20.5, 0, 0, 0.1])
    assert got[1].probability == round(e[0] / e.sum(), 4)
    assert [(got[i].quality, got[i].verdict, got[i].probability) for i in (3, 4, 5)] == [("input_bad", None, None), ("insufficient_samples", None, None), ("input_bad", None, None)]


def test_one_separator_a_file(spark):
    folder = tempfile.mkdtemp(prefix="spark-csv-", dir="/tmp")
    files = {"comma": ["9,39,39,65664,0.552,-0.146"] * 3 + ["9;39;39;65664;0.1;0.2", "short,1"], "semi": ["9;39;39;1.6562e+005;0.1;0.2"] * 4 + ["1,2,3,4,5,6"], "few": ["1,2,3,4,5,6"], "none": ["a,b"]}
    for name, lines in files.items():
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("\n".join(lines) + "\n\n")
    told = {r.file.rsplit("/", 1)[1]: (r.separator, r.rows, r.bad_lines, r.skipped) for r in src.wave_files(spark, folder, least_rows=2).collect()}
    assert told == {"comma.csv": (",", 3, 2, False), "semi.csv": (";", 4, 1, False), "few.csv": (",", 1, 0, True), "none.csv": (",", 0, 1, True)}
    rows = src.read_wave_csv(spark, folder, least_rows=2).orderBy("file", "seq").collect()
    assert [r.us for r in rows] == [65664.0] * 3 + [165620.0] * 4


def test_buffers_of_all_types_in_one_batch(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(200):
        k, big = src.DTYPES[i % 10], i % 3 == 0
        x = rng.integers(0, 100, rng.integers(0, 6)).astype((">" if big else "<") + k)
        raw = x.tobytes() + (b"\0" if i % 7 == 0 and x.dtype.itemsize > 1 else b"")
        want[i] = None if len(raw) % x.dtype.itemsize else x.astype(float).tolist()
        rows.append((i, 1, 1, (i % 10) + 100 * big, raw))
    fields = spark.createDataFrame([(1, 1, k + 100 * b, src.DTYPES[k], bool(b)) for k in range(10) for b in (0, 1)], "struct_id int, version int, number int, dtype string, big_endian boolean")
    df = spark.createDataFrame([*rows, (900, 1, 1, 77, b"12"), (901, 1, 1, 0, None)], "i int, struct_id int, version int, number int, payload binary").coalesce(1)
    got = {r.i: r["values"] for r in src.decode_structs(df, fields).collect()}
    assert got == want | {900: None, 901: None}
    only = {r.i: r["values"] for r in src.decode_structs(df.where("i >= 900"), fields).collect()}
    assert only == {900: None, 901: None}


def test_no_rank_is_no_status(spark):
    df = spark.createDataFrame([(1, ["stopped"]), (2, ["normal", "stopped", "warning"]), (3, [])], "i int, s array<string>")
    assert {r.i: r.x for r in df.select("i", rules.device_status(F.col("s")).alias("x")).collect()} == {1: None, 2: "warning", 3: None}
    rows = [("d", "m1", "status", "stopped", "ok"), ("d", "m2", "status", "attention", "ok"), ("d", "m2", "zone", "danger", "ok"), ("d", "m3", "status", "danger", "input_bad"), ("e", "m1", "status", "stopped", "ok")]
    f = spark.createDataFrame(rows, "device string, domain string, key string, text string, quality string")
    outputs = spark.createDataFrame([(m, k, k == "status") for m in ("m1", "m2", "m3") for k in ("status", "zone")], "domain string, key string, is_status boolean")
    assert {tuple(r) for r in rules.device_statuses(f, outputs, ["device"]).collect()} == {("d", "attention", 1, 2), ("e", None, 1, 1)}
