"""Readings of spectra as Spark expressions.

A spectrum is an array<double> of peak amplitudes, line i at i * step Hz, the constant first. with_spectrum makes it, the only step in
numpy; bands, bins, peaks, valleys and harmonics are array expressions, so each reading is one more column of the same job.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .signal import G, SCRATCH, spectrum


def with_spectrum(waves: DataFrame, hann: bool = False) -> DataFrame:
    """waves (wave, fs, ...) with lines and step; both null for a null or short wave, one with values that are not finite, or no rate."""

    def rows(batches):
        for batch in batches:
            lists = batch.column("wave").cast(pa.large_list(pa.float64()))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            out = [None] * batch.num_rows
            for n in np.unique(size[size > 3]):
                same, step = np.flatnonzero(size == n), max(1, SCRATCH // int(n) // 8)
                for at in (same[i : i + step] for i in range(0, len(same), step)):
                    x = pc.fill_null(lists.take(pa.array(at)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    fine = np.isfinite(x).all(1)
                    for i, a in zip(at[fine], spectrum(x[fine], 1.0, hann)[1]):
                        out[i] = a
            yield batch.append_column("lines", pa.array(out, pa.list_(pa.float64())))

    made = waves.mapInArrow(rows, StructType([*waves.schema.fields, StructField("lines", ArrayType(DoubleType()))]))
    made = made.withColumn("lines", F.when(F.col("fs") > 0, F.col("lines")))
    return made.withColumn("step", F.when(F.col("lines").isNotNull(), F.col("fs") / F.size("wave")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _highest(lines: Column, inside) -> Column:
    """The number of the largest of the lines whose numbers are inside, the lowest of equal ones; null without any."""
    marked = F.transform(lines, lambda a, i: F.when(inside(i), F.struct(a.alias("a"), (-i).alias("i"))))
    return -F.array_max(F.filter(marked, lambda x: x.isNotNull()))["i"]


def band_rms(lines: Column, step: Column, lo: float, hi: float, gain=lambda hz: F.lit(1.0)) -> Column:
    """RMS of the lines from lo to hi Hz, each amplitude times gain at its frequency."""
    inside = lambda i: (i * step >= lo) & (i * step <= hi)
    return F.sqrt(_sum(F.transform(lines, lambda a, i: F.when(inside(i), F.pow(a * gain(i * step), F.lit(2.0))).otherwise(0.0))) / 2)


def sensor_scalars(lines: Column, step: Column, lo: float = 10.0, hi: float = 1000.0) -> dict[str, Column]:
    """Acceleration (g), velocity (mm/s), displacement (um) and dominant frequency of a spectrum under a Hann window, lo above 0."""
    if lo <= 0:
        raise ValueError("a band that is integrated begins above 0 Hz")
    spread = math.sqrt(1.5)  # a Hann window spreads a line over its neighbours
    omega = lambda hz: 2 * math.pi * hz
    return {
        "acc": band_rms(lines, step, lo, hi) / spread,
        "vel": band_rms(lines, step, lo, hi, lambda hz: G * 1e3 / omega(hz)) / spread,
        "disp": 2 * math.sqrt(2) * band_rms(lines, step, lo, hi, lambda hz: G * 1e6 / (omega(hz) * omega(hz))) / spread,
        "freq": _highest(lines, lambda i: (i * step >= lo) & (i * step <= hi)) * step,
    }


def spectrum_bins(lines: Column, bins: int = 20) -> Column:
    """array of the largest amplitude in each of some ranges of lines as equal as can be, the constant left out; 0 for a range of no line."""
    count = F.size(lines) - 1
    each, more = F.floor(count / bins).cast("int"), count % bins
    part = lambda b: F.slice(lines, b * each + F.least(b, more) + 2, each + F.when(b < more, 1).otherwise(0))
    return F.when(lines.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.array_max(part(b)), F.lit(0.0))))


def valley_floor(lines: Column, line: Column) -> Column:
    """The noise beside a line: the mean of the two valleys that walking down on either side ends in; of one where the spectrum ends.

    A walk stops before the first line that is no lower. Never under 1e-12 of the largest line.
    """
    last = F.size(lines) - 1
    value = lambda j: F.get(lines, j)
    below = F.array_max(F.filter(F.sequence(F.lit(0), line), lambda j: (j == 0) | (value(j - 1) >= value(j))))
    above = F.array_min(F.filter(F.sequence(line, last), lambda j: (j == last) | (value(j + 1) >= value(j))))
    floor = F.when(line == 0, value(above)).when(line == last, value(below)).otherwise((value(below) + value(above)) / 2)
    return F.greatest(floor, 1e-12 * F.array_max(lines) + 1e-300)


#: Shares of a frequency within which its peak and the peaks of its multiples are sought, peak over noise, sideband over noise, harmonics.
NEAR_FIRST, NEAR_MULTIPLE, LEAST, SIDE, MOST = 0.02, 0.01, 3.0, 2.0, 6


def harmonic_reading(spectra: DataFrame, sidebands: bool = False) -> DataFrame:
    """spectra (lines, step, fault, and shaft for sidebands) with own_hz, ratios, harmonics and reading.

    own_hz is the peak near fault, whose multiples are the harmonics; ratios are peak over valley_floor of the harmonics in a row from the
    first that reach LEAST and, where asked and shaft is above 0, have a line of SIDE times the floor within two steps of a shaft frequency beside them, the peak
    itself aside. harmonics counts them; reading is log(1 + sum of ratios). All are null without a spectrum or a fault frequency inside it.
    """
    lines, step, fault = F.col("lines"), F.col("step"), F.col("fault")
    top = (F.size(lines) - 1) * step
    near = lambda centre, share, least: lambda i: F.abs(i * step - centre) <= F.greatest(share * centre, least)
    told = lines.isNotNull() & (fault > 0) & ((1 + NEAR_FIRST) * fault < top)
    out = spectra.withColumn("own_hz", F.when(told, _highest(lines, near(fault, NEAR_FIRST, step)) * step))
    centres = F.filter(F.transform(F.sequence(F.lit(1), F.lit(MOST)), lambda h: h * F.col("own_hz")), lambda c: c <= top)
    out = out.withColumn("_at", F.transform(centres, lambda c: _highest(lines, near(c, NEAR_MULTIPLE, step / 2))))
    out = out.withColumn("_peaks", F.transform("_at", lambda i: F.struct(i.alias("line"), F.get(lines, i).alias("peak"), valley_floor(lines, i).alias("floor"))))

    def good(p: Column) -> Column:
        found = F.coalesce(p["peak"] >= LEAST * p["floor"], F.lit(False))
        if not sidebands:
            return found
        shaft, hz = F.col("shaft"), p["line"] * step
        beside = lambda i: (i != p["line"]) & ((F.abs(i * step - hz + shaft) <= 2 * step) | (F.abs(i * step - hz - shaft) <= 2 * step))
        strongest = F.array_max(F.transform(lines, lambda a, i: F.when(beside(i), a).otherwise(0.0)))
        return found & (F.coalesce(shaft <= 0, F.lit(True)) | (strongest >= SIDE * p["floor"]))

    out = out.withColumn("_good", F.transform("_peaks", good))
    row = F.coalesce(F.nullif(F.array_position("_good", F.lit(False)), F.lit(0)) - 1, F.size("_good")).cast("int")
    out = out.withColumn("harmonics", F.when(F.col("own_hz").isNotNull(), row))
    out = out.withColumn("ratios", F.transform(F.slice("_peaks", F.lit(1), F.col("harmonics")), lambda p: p["peak"] / p["floor"]))
    return out.withColumn("reading", F.log1p(_sum(F.col("ratios")))).drop("_at", "_peaks", "_good")
