"""Swinging-door compression with an absolute error, whatever a series is cut into.

The published algorithm: a sample that is kept opens a corridor to all later ones; when the sample at hand would close it, the one
before is kept and opens the next. The first sample of a series stays, and so does the last.

The batch form cuts series into blocks of time and runs them side by side. A block tells what it needs of the corridor that enters
it: the convex hulls of its samples plus and minus the error decide whether any such corridor passes it open. A pass
over these few rows of a series carries corridors from block to block; where one closes within a block, the block's own earlier
run is taken to have fallen into step by its end. Then blocks run with the corridors that enter them, and those that did not end as was taken
are corrected in another round, until none is left. Each round makes one more block right at least; two are the rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import written
from .stateful import FORGET_S, InOrder, _run

#: A corridor: where it opens, its slopes, the last sample seen, and whether that is the one it opens at.
STATE = "at_us long, at_value double, high double, low double, last_us long, last_seq long, last_value double, shut boolean"
CHUNK = 64
#: Samples that a block of a series of usual density holds.
BLOCK_ROWS = 20_000


def walk(us: np.ndarray, seq: np.ndarray, value: np.ndarray, error: float, state: tuple | None) -> tuple[list[tuple[int, int, float]], tuple | None]:
    """Samples (us, seq, value) kept while going over those given, in order, and the corridor after them; without one a series begins."""
    kept, i, n, chunk = [], 0, len(us), CHUNK
    if not n:
        return kept, state
    if state is None:
        kept.append((int(us[0]), int(seq[0]), float(value[0])))
        state, i = (*kept[0][::2], np.inf, -np.inf, *kept[0], True), 1
    at, at_value, high, low, *last, shut = state
    while i < n:
        j = min(n, i + chunk)
        dt = np.maximum((us[i:j] - at) / 1e6, 1e-9)
        highs = np.minimum(np.minimum.accumulate((value[i:j] + error - at_value) / dt), high)
        lows = np.maximum(np.maximum.accumulate((value[i:j] - error - at_value) / dt), low)
        shuts = np.flatnonzero(lows > highs)
        if len(shuts):
            k = i + int(shuts[0])
            last = last if k == 0 else [int(us[k - 1]), int(seq[k - 1]), float(value[k - 1])]
            kept.append(tuple(last))
            at, at_value, high, low, i, chunk = last[0], last[2], np.inf, -np.inf, k, CHUNK
        else:
            high, low, i, chunk = float(highs[-1]), float(lows[-1]), j, 2 * chunk
    return kept, (at, at_value, high, low, int(us[-1]), int(seq[-1]), float(value[-1]), shut and i == 1 and n == 1)


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the lower convex hull of points in order of x: the least slope from any point before them is to one of these."""
    out: list[int] = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        while len(out) > 1 and (y[out[-1]] - y[out[-2]]) * (a - x[out[-2]]) >= (b - y[out[-2]]) * (x[out[-1]] - x[out[-2]]):
            out.pop()
        out.append(i)
    return np.array(out, np.int64)


def _same(a: tuple | None, b: tuple | None) -> bool:
    """Corridors of one opening and one last sample; slopes may differ by rounding, as they are least values over hulls or over all samples."""
    if a is None or b is None:
        return a is b
    return a[0] == b[0] and a[4:6] == b[4:6] and a[7] == b[7] and np.allclose(a[2:4], b[2:4], 1e-9, 1e-12)


def _packed(state: tuple | None) -> list:
    return [None] * 8 if state is None else list(state)


def _unpacked(values) -> tuple | None:
    return None if pd.isna(values[0]) else (int(values[0]), float(values[1]), float(values[2]), float(values[3]), int(values[4]), int(values[5]), float(values[6]), bool(values[7]))


def swinging_door(samples: DataFrame, by: list[str], error: float, block_s: float | None = None) -> DataFrame:
    """The samples (by, t, seq, value, more) that swinging-door compression keeps; those without a value go. (by, t, seq) names a sample.

    A block of block_s seconds of one series is held in memory at once; without block_s, as long as BLOCK_ROWS samples are in the mean of all
    series. What is kept does not depend on it. Empty tables give empty results.
    """
    rows = samples.where("value IS NOT NULL AND t IS NOT NULL")
    if block_s is None:
        n, low, high = rows.agg(F.count("*"), F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).first()
        if not n:
            return rows.limit(0)
        block_s = max(1.0, (high - low + 1) / 1e6 * rows.select(*by).distinct().count() * BLOCK_ROWS / n)
    block = F.floor(F.unix_micros("t") / int(block_s * 1e6))
    slim = written(rows.select(*by, block.alias("block"), F.unix_micros("t").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value")), "door-rows")
    keys = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in by)
    state = [x.split()[0] for x in STATE.split(", ")]
    put = lambda prefix: ", ".join(f"{prefix}_{x}" for x in STATE.split(", "))
    own = [*by, "block"]

    def ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(["us", "seq"], kind="stable")
        return pdf["us"].to_numpy(np.int64), pdf["seq"].to_numpy(np.int64), pdf["value"].to_numpy(float)

    def summed(key, pdf):
        us, seq, value = ordered(pdf)
        _, end = walk(us, seq, value, error, None)
        x = us / 1e6 - us[0] / 1e6
        up, down = hull(x, value + error), hull(x, error - value)
        names = [*own, "up_us", "up_value", "down_us", "down_value", *(f"end_{s}" for s in state)]
        return pd.DataFrame([[*key, us[up], value[up], us[down], value[down], *_packed(end)]], columns=names)

    blocks = slim.groupBy(*own).applyInPandas(summed, f"{keys}, block long, up_us array<long>, up_value array<double>, down_us array<long>, down_value array<double>, {put('end')}")
    blocks = written(blocks, "door-blocks")

    def passed(block_row, entry: tuple) -> tuple | None:
        """The corridor after a block that it passes open, else None."""
        at, at_value, high, low = entry[:4]
        high = min(high, ((block_row.up_value + error - at_value) / np.maximum((block_row.up_us - at) / 1e6, 1e-9)).min())
        low = max(low, ((block_row.down_value - error - at_value) / np.maximum((block_row.down_us - at) / 1e6, 1e-9)).max())
        return (at, at_value, high, low, int(block_row.end_last_us), int(block_row.end_last_seq), float(block_row.end_last_value), False) if low <= high else None

    def carried(key, pdf):
        """Each block's entering corridor and the one that it is taken to leave, from what runs so far have shown."""
        out, entry = [], None
        for r in pdf.sort_values("block").itertuples(index=False):
            ran = _unpacked([getattr(r, f"ran_{s}") for s in state])
            seen = bool(r.ran) and _same(_unpacked([getattr(r, f"from_{s}") for s in state]), entry)
            end = _unpacked([getattr(r, f"end_{s}") for s in state])
            leaves = ran if seen else (end if entry is None else passed(r, entry)) or (ran if r.ran else end)
            out.append([*key, r.block, *_packed(entry), *_packed(leaves), not seen])
            entry = leaves
        return pd.DataFrame(out, columns=[*own, *(f"from_{s}" for s in state), *(f"to_{s}" for s in state), "due"])

    def ran(key, left, right):
        """Keeps of a block with its entering corridor, as rows (us, seq), and one row, without seq, of the corridor that it leaves."""
        entry = _unpacked(right[[f"from_{s}" for s in state]].iloc[0].tolist())
        kept, end = walk(*ordered(left), error, entry)
        body = [[*key, us, seq, *[None] * 16] for us, seq, _ in kept] + [[*key, None, None, *_packed(entry), *_packed(end)]]
        return pd.DataFrame(body, columns=[*own, "us", "seq", *(f"from_{s}" for s in state), *(f"ran_{s}" for s in state)])

    runs = None
    while True:
        told = blocks.withColumn("ran", F.lit(False)).withColumns({f"{p}_{s}": F.lit(None).cast(blocks.schema[f"end_{s}"].dataType) for p in ("from", "ran") for s in state})
        if runs is not None:
            ends = runs.where("seq IS NULL").select(*own, *[f"{p}_{s}" for p in ("from", "ran") for s in state]).withColumn("ran", F.lit(True))
            told = blocks.join(ends, own, "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
        plan = told.groupBy(*by).applyInPandas(carried, f"{keys}, block long, {put('from')}, {put('to')}, due boolean")
        plan = written(plan, "door-plan")
        due = plan.where("due").drop("due")
        if due.isEmpty():
            break
        fresh = slim.join(due.select(*own), own, "left_semi").groupBy(*own).cogroup(due.groupBy(*own)).applyInPandas(ran, f"{keys}, block long, us long, seq long, {put('from')}, {put('ran')}")
        kept = fresh if runs is None else fresh.union(runs.join(due.select(*own), own, "left_anti"))
        runs = written(kept, "door-runs")
    if runs is None:
        return rows.limit(0)
    final = blocks.groupBy(*by).agg(F.max("block").alias("block")).join(plan, own).where("NOT to_shut").select(*by, F.col("to_last_us").alias("us"), F.col("to_last_seq").alias("seq"))
    keep = runs.where("seq IS NOT NULL").select(*by, "us", "seq").union(final).distinct()
    return rows.withColumn("us", F.unix_micros("t")).join(keep, [*by, "us", "seq"], "left_semi").select(samples.columns)


def swinging_door_by_series(samples: DataFrame, by: list[str], error: float) -> DataFrame:
    """(by, t, seq, value) of the samples that swinging_door keeps, in one pass: for many series, none of them too long for one task.

    A task streams through its sorted series with one corridor of state.
    """
    rows = samples.where("value IS NOT NULL AND t IS NOT NULL").select(*by, F.unix_micros("t").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))

    def door(batches):
        key, state = None, None
        closed = lambda: [] if state is None or state[7] else [(*key, *state[4:7])]
        for batch in batches:
            out = []
            for own, part in batch.groupby(by, sort=False, dropna=False):
                if own != key:
                    out += closed()
                    key, state = own, None
                keeps, state = walk(part["us"].to_numpy(), part["seq"].to_numpy(), part["value"].to_numpy(float), error, state)
                out += [(*key, *x) for x in keeps]
            yield pd.DataFrame(out, columns=[*by, "us", "seq", "value"])
        yield pd.DataFrame(closed(), columns=[*by, "us", "seq", "value"])

    kept = rows.repartition(*by).sortWithinPartitions(*by, "us", "seq").mapInPandas(door, rows.schema)
    return kept.select(*by, F.timestamp_micros("us").alias("t"), "seq", "value")


class Door(InOrder):
    KEPT, COLUMNS = STATE, ["key", "t", "seq", "value"]

    def __init__(self, error: float, forget_s: float):
        super().__init__(forget_s)
        self.error = error

    def settle(self, key, kept, us, seq, value, label, now):
        whole = ~np.isnan(value)
        keeps, state = walk(us[whole], seq[whole], value[whole], self.error, kept)
        return state, [(key[0], *x) for x in keeps], None

    def farewell(self, key, kept):
        return [] if kept is None or kept[7] else [(key[0], *kept[4:7])]


def swinging_door_stream(samples: DataFrame, error: float, delay_s: float = 0.0, forget_s: float = FORGET_S) -> DataFrame:
    """(key, t, seq, value) of samples that swinging_door keeps, as soon as they are known; the last of a key when it is forgotten."""
    return _run(samples, Door(error, forget_s), "t timestamp, seq long, value double", delay_s)
