"""Readings of spectra as expressions against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import signal, spectra
from tremorlake.operators import models


def waves_of(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i, (n, fs) in enumerate([(64, 640.0), (200, 1000.0), (255, 2000.0), (1024, 4096.0)] * 3):
        t, fault = np.arange(n) / fs, fs / 16
        tone = sum(np.sin(2 * np.pi * h * fault * 1.005 * t) / h for h in range(1, 2 + i // 3))
        side = np.sin(2 * np.pi * fault * t) * np.sin(2 * np.pi * fs / 64 * t)
        rows.append((i, (tone + 0.8 * side + 0.05 * rng.normal(size=n)).tolist(), fs, fault, fs / 64))
    return rows


SCHEMA = "i int, wave array<double>, fs double, fault double, shaft double"
ODD = [(90, None, 100.0, 9.0, 1.0), (91, [1.0, 2.0], 100.0, 9.0, 1.0), (92, [1.0, None, 3.0, 4.0, 5.0], 100.0, 9.0, 1.0), (93, [float("nan")] * 8, 100.0, 9.0, 1.0), (94, [1.0, 2.0, 1.0, 0.0] * 4, None, 9.0, 1.0)]


def test_scalars_and_bins_agree_with_arrays(spark):
    rows = waves_of()
    made = spectra.with_spectrum(spark.createDataFrame(rows + ODD, SCHEMA), hann=True)
    scalars = spectra.sensor_scalars(F.col("lines"), F.col("step"))
    got = {r.i: r for r in made.select("i", *[c.alias(n) for n, c in scalars.items()]).collect()}
    for i, wave, fs, *_ in rows:
        want = signal.sensor_scalars(np.array(wave), fs)
        assert all(math.isclose(got[i][n], float(want[n]), rel_tol=1e-9) for n in want)
    assert all(got[i][n] is None for i in range(90, 95) for n in scalars)
    for bins in (1, 7, 20, 40):
        made = spectra.with_spectrum(spark.createDataFrame(rows + ODD, SCHEMA)).select("i", spectra.spectrum_bins(F.col("lines"), bins).alias("b")).collect()
        got = {r.i: r.b for r in made}
        assert all(np.allclose(got[i], signal.spectrum_bins(np.array(w), fs, bins)) and len(got[i]) == bins for i, w, fs, *_ in rows) and got[91] is None


def floor_by_walk(s, at):
    down, up = at, at
    while down > 0 and s[down - 1] < s[down]:
        down -= 1
    while up < len(s) - 1 and s[up + 1] < s[up]:
        up += 1
    return s[up] if at == 0 else s[down] if at == len(s) - 1 else (s[down] + s[up]) / 2


def reading_by_walk(s, step, fault, shaft, sidebands):
    hz = np.arange(len(s)) * step
    if not fault > 0 or 1.02 * fault >= hz[-1]:
        return None, None, None
    near = [j for j in range(len(s)) if abs(hz[j] - fault) <= max(0.02 * fault, step)]
    own = hz[max(near, key=lambda j: s[j])]
    ratios = []
    for h in range(1, 7):
        inside = [j for j in range(len(s)) if abs(hz[j] - h * own) <= max(0.01 * h * own, step / 2)]
        if h * own > hz[-1] or not inside:
            break
        at = max(inside, key=lambda j: s[j])
        floor = floor_by_walk(s, at)
        beside = [s[j] for j in range(len(s)) if j != at and min(abs(hz[j] - hz[at] + shaft), abs(hz[j] - hz[at] - shaft)) <= 2 * step]
        if s[at] < 3 * floor or (sidebands and shaft > 0 and max(beside, default=0) < 2 * floor):
            break
        ratios.append(s[at] / floor)
    return own, len(ratios), math.log1p(sum(ratios))


@pytest.mark.parametrize("sidebands", [False, True])
def test_harmonics_against_a_walk(spark, sidebands):
    rows = waves_of() + [(50, waves_of()[0][1], 640.0, 0.0, 0.0), (51, waves_of()[0][1], 640.0, 319.0, 0.0), (52, waves_of()[0][1], 640.0, 40.0, 0.0)]
    out = spectra.harmonic_reading(spectra.with_spectrum(spark.createDataFrame(rows + ODD, SCHEMA)), sidebands).collect()
    got, counts = {r.i: r for r in out}, set()
    for i, wave, fs, fault, shaft in rows:
        own, n, reading = reading_by_walk(signal.spectrum(np.array(wave), fs)[1], fs / len(wave), fault, shaft, sidebands)
        assert got[i].harmonics == n
        counts.add(n)
        assert own is None and got[i].reading is None or math.isclose(got[i].own_hz, own) and math.isclose(got[i].reading, reading, rel_tol=1e-9, abs_tol=1e-12)
    assert len(counts) >= 3 and all(got[i].harmonics is None for i in range(90, 95))


def test_press_resampled_as_numpy_would(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 9, m).astype(float).tolist(), rng.normal(size=m).tolist(), rng.normal(size=m).tolist()) for i, m in enumerate([2, 3, 9, 40, 120])]
    rows += [(10, [1.0, 1.0], [1.0, 2.0], [1.0, 2.0]), (11, [1.0, 2.0], [1.0], [1.0, 2.0]), (12, None, [1.0], [1.0]), (13, [1.0, None], [1.0, 2.0], [1.0, 2.0]), (14, [], [], []), (15, [1.0, float("nan")], [1.0, 2.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "i int, position array<double>, velocity array<double>, force array<double>")
    got = {r.i: r for r in models.resample_press(df, 16).collect()}
    for i, p, v, f in rows[:5]:
        if max(p) > min(p):
            want = signal.resampled_by_position(np.array(p), [np.array(v), np.array(f)], 16)
            at = np.array(got[i].position_n)
            clear = np.abs(at[:, None] - np.array(p)).min(1) > 1e-9  # at steps of equal displacements an ulp decides
            clear[[0, -1]] = True
            assert np.allclose(at, want[0]) and np.allclose(np.array(got[i].velocity_n)[clear], want[1][clear]) and np.allclose(np.array(got[i].force_n)[clear], want[2][clear])
    assert all(got[i].position_n is None and got[i].force_n is None for i in range(10, 16))
