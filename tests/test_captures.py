"""Capture files against numpy, refused ones with their reason."""

import os
import tempfile

import numpy as np

from tremorlake.functions import signal
from tremorlake.sources import captures


def test_features_of_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-captures-", dir="/tmp")
    rng = np.random.default_rng(6)
    fs, good = 1000.0, {}
    for label, name in (("normal", "12.5"), ("normal", "20"), ("imbalance", "33.25")):
        os.makedirs(f"{folder}/{label}", exist_ok=True)
        good[f"{label}/{name}"] = rng.standard_normal((300, 8)) + np.sin(2 * np.pi * 50 * np.arange(300) / fs)[:, None]
        with open(f"{folder}/{label}/{name}.csv", "w") as f:
            f.write("\n".join(",".join(map(repr, map(float, row))) for row in good[f"{label}/{name}"]) + "\n\n")
    line = ",".join(["1.5e+000"] * 8)
    bad = {"a": [line] * 10, "b": ["1,2,3,4,5,6,7"] * 300, "c": [line] * 299 + ["1,2,3"], "d": [line] * 299 + [line.replace("1.5", "one", 1)], "e": [line] * 299 + [line + ",", "nan" + line[8:]], "f": [" " + line] * 250}
    for name, lines in bad.items():
        with open(f"{folder}/normal/{name}.csv", "w") as f:
            f.write("\n".join(lines))
    got = {r.file.split("/", 2)[2].removeprefix(folder[1:] + "/").removesuffix(".csv"): r for r in captures.read_capture_features(spark, f"{folder}/*", fs, least_rows=200).collect()}
    reject = {k[-1]: r.reject for k, r in got.items() if r.reject}
    assert reject == {"a": "short: 10 rows", "b": "columns: 7", "c": "ragged: 3 to 8 columns", "d": "not numbers: 1 lines", "e": "not numbers: 2 lines"}
    assert all(r.channels is None for r in got.values() if r.reject)
    flat = next(r for k, r in got.items() if k.endswith("/f"))
    assert flat.reject is None and flat.channels[0].crest is None and flat.channels[0].mean == 1.5
    for k, x in good.items():
        r = next(r for name, r in got.items() if name.endswith(k))
        assert (r.label, r.speed, r.rows, [c.channel for c in r.channels]) == (k.split("/")[0], float(k.split("/")[1]), 300, [1, 2, 3, 4, 5, 6])
        for c in r.channels:
            w = x[:, c.channel]
            y = w - w.mean()
            assert np.allclose([c.mean, c.deviation, c.kurt, c.crest], [w.mean(), y.std(), (y**4).mean() / y.var() ** 2, np.abs(y).max() / y.std()])
            assert np.allclose([c.acc, c.vel, c.disp, c.freq], [v for v in signal.sensor_scalars(w, fs).values()]) and np.allclose(c.bins, signal.spectrum_bins(w, fs))
