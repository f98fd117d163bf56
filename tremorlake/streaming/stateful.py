"""Streaming operators with state per key on transformWithState: alarms, delays, carried state, compression.

All take samples in order of time, however the stream is cut into micro-batches: those ahead of the watermark wait in
the key's state, and once it has passed them they are settled by (t, seq). A delay that ends between samples wakes its key by an
event-time timer. State goes when its key has had no sample for forget_s seconds of event time, so dead keys leave nothing; a key that
returns later begins anew. Each operator has a batch twin that gives the same rows for samples up to the watermark.

Rows of the streams that they take: key, t, seq (order among equal times), value and, where it is named, label. Rows without a
key or time are ignored; NaN counts as no number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORGET_S = 30 * 86400


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """transformWithState keeps its state in RocksDB only, with copies in the checkpoint; set it for queries started from now on."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


class InOrder(StatefulProcessor):
    """Samples of a key in order of time, each once the watermark has passed it."""

    KEPT = ""  # schema of what a key keeps
    COLUMNS: list[str] = []  # of the rows that go out

    def __init__(self, forget_s: float):
        self.forget = int(forget_s * 1e6)

    def settle(self, key, kept: tuple | None, us: np.ndarray, seq: np.ndarray, value: np.ndarray, label: np.ndarray, now: int) -> tuple[tuple | None, list[tuple], int | None]:
        """What the key keeps after its samples, rows that go out, and when to wake it, in microseconds; now is the watermark. No value is NaN."""
        raise NotImplementedError

    def farewell(self, key, kept: tuple | None) -> list[tuple]:
        """Rows that go out when a key is forgotten."""
        return []

    def init(self, handle) -> None:
        # one value a key: each call for state goes to the JVM and back
        self.handle = handle
        self.kept = handle.getValueState("kept", f"has boolean, seen long, wait_us binary, wait_seq binary, wait_value binary, wait_label string, {self.KEPT}")
        self.none = (None,) * (self.KEPT.count(",") + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.kept.update((True, None, *NOTHING, *self.started(initialState)))

    def started(self, initial: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(x["t"].to_numpy("datetime64[us]").astype(np.int64), x["seq"].to_numpy(np.int64), x["value"].to_numpy(float), x["label"].to_numpy(object)) for x in rows]
        return self._settled(key, tuple(map(np.concatenate, zip(*parts))), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settled(key, None, timerValues)

    def _settled(self, key, new: tuple | None, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        has, last, us, seq, value, label, *before = self.kept.get() or (False, None, *NOTHING, *self.none)
        rows = _unpacked(us, seq, value, label)
        if new is not None:
            rows = tuple(np.concatenate([a, b]) for a, b in zip(rows, new)) if len(rows[0]) else new
        early = rows[0] > now
        held, rows = tuple(x[early] for x in rows), tuple(x[~early] for x in rows)
        order = np.lexsort((rows[1], rows[0]))
        us = rows[0][order]
        before = tuple(before) if has else None
        kept, out, wake = self.settle(key, before, us, *(x[order] for x in rows[1:]), now)
        last = int(us[-1]) if len(us) else last
        waits = len(held[0]) > 0
        if last is not None and last + self.forget <= now and not waits:
            out = out + self.farewell(key, kept)
            self.kept.clear()
        else:
            kept = before if kept is None else kept
            if len(us) or new is not None or kept != before:
                self.kept.update((kept is not None, last, *_packed(*held), *(self.none if kept is None else kept)))
            wakes = [int(held[0].min())] if waits else [] if last is None else [last + self.forget]
            self.handle.registerTimer(-(-min([*wakes, *([wake] if wake is not None else [])], default=now + self.forget) // 1000))
        return iter([pd.DataFrame(out, columns=self.COLUMNS)] if out else [])


#: No samples that wait, as the state has them.
NOTHING = (None, None, None, None)


def _packed(us: np.ndarray, seq: np.ndarray, value: np.ndarray, label: np.ndarray) -> tuple:
    """Samples that wait as one row of state."""
    if not len(us):
        return NOTHING
    return us.tobytes(), seq.tobytes(), value.tobytes(), json.dumps([None if pd.isna(x) else x for x in label]) if pd.notna(label).any() else None


def _unpacked(us: bytes | None, seq: bytes | None, value: bytes | None, label: str | None) -> tuple:
    us, seq, value = (np.frombuffer(x or b"", t) for x, t in ((us, np.int64), (seq, np.int64), (value, float)))
    return us, seq, value, np.full(len(us), None, object) if label is None else np.array(json.loads(label), object)


def _stream(samples: DataFrame, delay_s: float, label: Column | None) -> DataFrame:
    keep_state_in_rocksdb(samples.sparkSession)
    seq = F.col("seq").cast("long") if "seq" in samples.columns else F.lit(0).cast("long")
    value = F.col("value").cast("double") if "value" in samples.columns else F.lit(None).cast("double")
    rows = samples.where("key IS NOT NULL AND t IS NOT NULL").select("key", "t", F.coalesce(seq, F.lit(0)).alias("seq"), value.alias("value"), (F.lit(None) if label is None else label).cast("string").alias("label"))
    return rows.withWatermark("t", f"{int(delay_s * 1000)} milliseconds")


def _run(samples: DataFrame, processor: InOrder, schema: str, delay_s: float, label: Column | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The rows of schema; its times leave the processor in microseconds."""
    rows = _stream(samples, delay_s, label)
    out = f"key {rows.schema['key'].dataType.simpleString()}, {schema}"
    told = rows.groupBy("key").transformWithStateInPandas(processor, out.replace(" timestamp", " long"), "append", "EventTime", initialState=None if initial is None else initial.groupBy("key"))
    return told.select(*[F.timestamp_micros(c).alias(c) if f"{c} timestamp" in schema.split(", ") else F.col(c) for c in processor.COLUMNS])


def _number(v: float) -> float | None:
    return None if np.isnan(v) else float(v)


class LimitLevels(InOrder):
    KEPT, COLUMNS = "active long", ["key", "level", "kind", "t", "seq", "value"]

    def __init__(self, limits: dict[str, float], dead_band: float, forget_s: float):
        super().__init__(forget_s)
        self.limits, self.dead_band = limits, dead_band

    def started(self, initial):
        on = set(initial.loc[initial["active"].astype(bool), "level"])
        return (sum(1 << j for j, name in enumerate(self.limits) if name in on),)

    def settle(self, key, kept, us, seq, value, label, now):
        active, out = kept[0] if kept else 0, []
        if not len(us):
            return kept, out, None
        after = 0
        for j, (name, limit) in enumerate(self.limits.items()):
            v, edge = (value, limit) if name in ("HI", "HH") else (-value, -limit)
            says = np.where(v >= edge, 1, np.where(v <= edge - self.dead_band, 0, -1))
            says = np.concatenate([[active >> j & 1], says])
            state = says[np.maximum.accumulate(np.where(says >= 0, np.arange(len(says)), 0))]
            out += [(key[0], name, "raised" if state[i + 1] else "cleared", int(us[i]), int(seq[i]), float(value[i])) for i in np.flatnonzero(np.diff(state))]
            after |= int(state[-1]) << j
        out.sort(key=lambda r: (r[3], r[4]))
        return (after,), out, None


def limit_alarms_stream(samples: DataFrame, limits: dict[str, float], dead_band: float, delay_s: float = 0.0, initial: DataFrame | None = None, forget_s: float = FORGET_S) -> DataFrame:
    """(key, level, kind, t, seq, value): each level of LL, LO, HI, HH raised at its limit and cleared one dead band inside it.

    initial (key, level, active) says what is active before the stream begins, as a batch run over the history gives it.
    """
    return _run(samples, LimitLevels(limits, dead_band, forget_s), "level string, kind string, t timestamp, seq long, value double", delay_s, initial=initial)


class StateTable(InOrder):
    KEPT, COLUMNS = "state string", ["key", "before", "state", "t", "seq", "value"]

    def started(self, initial):
        return (str(initial["state"].iloc[0]),)

    def settle(self, key, kept, us, seq, value, state, now):
        if not len(us):
            return kept, [], None
        before = np.concatenate([np.array([kept[0] if kept else None], object), state[:-1]])
        return (state[-1],), [(key[0], before[i], state[i], int(us[i]), int(seq[i]), _number(value[i])) for i in np.flatnonzero(state != before)], None


def state_changes_stream(samples: DataFrame, state: Column, delay_s: float = 0.0, initial: DataFrame | None = None, forget_s: float = FORGET_S) -> DataFrame:
    """(key, before, state, t, seq, value) where the state of a table of states, as alarms.state_of gives it, changes; initial: (key, state)."""
    return _run(samples, StateTable(forget_s), "before string, state string, t timestamp, seq long, value double", delay_s, state, initial)


class Debounced(InOrder):
    KEPT, COLUMNS = "alarm boolean, state boolean, since long, value double", ["key", "kind", "t", "value"]

    def __init__(self, on_s: float, off_s: float, forget_s: float):
        super().__init__(forget_s)
        self.wait = {True: int(on_s * 1e6), False: int(off_s * 1e6)}

    def settle(self, key, kept, us, seq, values, label, now):
        alarm, on, since, value = kept or (False, None, 0, None)
        out = []

        def end(upto: int) -> None:
            nonlocal alarm
            if on is not None and on != alarm and upto - since >= self.wait[on]:
                alarm = on
                out.append((key[0], "raised" if on else "cleared", since, value))

        says = np.asarray(label == "true", bool)
        for i in np.flatnonzero(np.diff(says.astype(int), prepend=-1 if on is None or not len(says) else int(on))).tolist():
            end(int(us[i]))
            on, since, value = bool(says[i]), int(us[i]), _number(values[i])
        end(now)
        if on is None:
            return None, out, None
        return (alarm, on, since, value), out, since + self.wait[on] if on != alarm else None


def debounced_stream(samples: DataFrame, condition: Column, on_s: float, off_s: float, delay_s: float = 0.0, forget_s: float = FORGET_S) -> DataFrame:
    """(key, kind, t, value): raised when the condition has held on_s, cleared when it has been gone off_s, on the axis of event time.

    A timer ends the delay, not the next sample; t and value are those of the sample at which the condition began.
    """
    held = F.coalesce(condition, F.lit(False)).cast("string")
    return _run(samples, Debounced(on_s, off_s, forget_s), "kind string, t timestamp, value double", delay_s, held)


class CarriedState(InOrder):
    KEPT, COLUMNS = "state string, since long, writes long", ["key", "state", "since", "writes"]

    def __init__(self, most_bytes: int, forget_s: float):
        super().__init__(forget_s)
        self.most_bytes = most_bytes

    def legal(self, text) -> bool:
        try:
            return isinstance(text, str) and len(text.encode()) <= self.most_bytes and isinstance(json.loads(text), dict)
        except ValueError:
            return False

    def settle(self, key, kept, us, seq, value, label, now):
        state, since, writes = kept or ("", 0, 0)
        for at, text in zip(us.tolist(), label):
            if self.legal(text):
                state, since, writes = ("", 0, 0) if json.loads(text) == {} else (text, since or at, writes + 1)
        return (state, since, writes), [(key[0], state or None, since or None, writes)] if len(us) else [], None


def carried_state(beats: DataFrame, most_bytes: int = 256 * 1024, delay_s: float = 0.0, forget_s: float = FORGET_S) -> DataFrame:
    """State of each binding across beats (key, t, state_json): null keeps it, {} clears it, others replace it if they are JSON objects of
    bounded size. Rows (key, state, since, writes) after each batch in which beats were settled, since the time of the first write."""
    return _run(beats, CarriedState(most_bytes, forget_s), "state string, since timestamp, writes long", delay_s, F.col("state_json"))


def silence_stream(samples: DataFrame, points: DataFrame, limit_s: float = 300.0, delay_s: float = 0.0) -> DataFrame:
    """One out-of-service row (code -1007) for each point of a source, at the source's last sample, once it has been silent for limit_s.

    A session window per source closes when event time has gone limit_s past its last sample, and writes once; the next sample opens a new
    one. So it fires once for each silence, re-arms by itself, keeps a row of state for a live source and none for a dead one. points
    (source, tag_id) is a table, joined as it stands at each batch; on a whole table instead of a stream this also tells silences that are over.
    """
    rows = samples.where("source IS NOT NULL")
    if samples.isStreaming:
        rows = rows.withWatermark("t", f"{int(delay_s * 1000)} milliseconds")
    session = F.session_window("t", f"{int(limit_s * 1000)} milliseconds")
    ended = rows.groupBy(session, "source").agg(F.max("t").alias("t")).join(points.select("source", "tag_id"), "source")
    # not the session's own end: Spark pushes filters on that below the merging of sessions
    since = F.timestamp_micros(F.unix_micros("t") + int(limit_s * 1_000_000)).alias("silent_from")
    return ended.select("source", "tag_id", "t", since, F.lit(None).cast("double").alias("value"), F.lit(-1007).alias("status_code"))
