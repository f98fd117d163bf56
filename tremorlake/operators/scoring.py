"""Scoring of windows and curves by given networks, batches of rows at a time, one session a Python worker.

A network comes with its contract: the order of its channels, its scaling, the classes of its first output and the names of the numbers
that further outputs give. The contract is checked on the driver before a job starts; rows that can't be scored keep their place with the
quality that says why.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .models import press_features, resample_press

#: Horizons in s of the severities that a network for drives tells.
HORIZONS = (30, 60, 120)
_SESSIONS: dict = {}


@dataclass(frozen=True)
class Network:
    """An ONNX file with what its inputs and outputs mean. scale: (kind, a, b), zscore with means and deviations, or minmax with least and largest values, one a channel."""

    payload: bytes
    channels: tuple[str, ...]
    classes: tuple[str, ...]
    numbers: tuple[tuple[str, ...], ...] = ()
    scale: tuple[str, tuple[float, ...], tuple[float, ...]] | None = None
    channels_first: bool = True

    def problems(self) -> list[str]:
        """What is wrong with the contract, by itself and against the file."""
        out = []
        for what, names in (("channel", self.channels), ("class", self.classes), ("number", [n for head in self.numbers for n in head])):
            out += [f"{what} {n!r} twice" for n in sorted(set(names)) if list(names).count(n) > 1]
        if self.scale is not None:
            kind, a, b = self.scale
            spread = np.array(b, float) if kind == "zscore" else np.subtract(b, a) if len(a) == len(b) else np.zeros(1)
            out += [f"scale {kind!r}"] if kind not in ("zscore", "minmax") else []
            out += ["scale of another number of channels"] if not len(a) == len(b) == len(self.channels) else []
            out += ["scale without spread"] if not np.isfinite([*a, *b]).all() or not (spread > 0).all() else []
        try:
            session = _session(self.payload)
        except Exception as e:  # a file that is no network
            return [*out, f"no network: {type(e).__name__}"]
        outputs = session.get_outputs()
        out += [f"{len(session.get_inputs())} inputs"] if len(session.get_inputs()) != 1 else []
        out += [f"{len(outputs)} outputs for {1 + len(self.numbers)} heads"] if len(outputs) != 1 + len(self.numbers) else []
        for o, wanted in zip(outputs, (len(self.classes), *map(len, self.numbers))):
            width = o.shape[-1] if len(o.shape) > 1 else 1
            out += [f"output {o.name} has {width} numbers, not {wanted}"] if isinstance(width, int) and width != wanted else []
        return out


def _session(payload: bytes):
    import onnxruntime

    key = hashlib.sha256(payload).digest()
    if key not in _SESSIONS:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        _SESSIONS[key] = onnxruntime.InferenceSession(payload, options, providers=["CPUExecutionProvider"])
    return _SESSIONS[key]


def _probabilities(y: np.ndarray) -> np.ndarray:
    """Rows that are probabilities as they are, others by softmax."""
    already = (y >= 0).all(1) & (np.abs(y.sum(1) - 1) <= 1e-3)
    e = np.exp(y - y.max(1, keepdims=True))
    return np.where(already[:, None], y, e / e.sum(1, keepdims=True))


def predict(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """Probabilities of the classes and each further head's numbers, of x (rows, channels, points)."""
    session = _session(net.payload)
    if net.scale is not None:
        kind, a, b = net.scale
        low, spread = np.array(a)[:, None], np.array(b)[:, None] - (np.array(a)[:, None] if kind == "minmax" else 0)
        x = (x - low) / spread
    x = np.ascontiguousarray(x if net.channels_first else x.transpose(0, 2, 1), np.float32)
    given, names = session.get_inputs()[0], [o.name for o in session.get_outputs()]
    step = 1 if given.shape[0] == 1 else len(x)  # a network of one row at a time
    parts = [session.run(names, {given.name: x[i : i + step]}) for i in range(0, len(x), step)]
    heads = [np.concatenate([np.asarray(p[k], float).reshape(min(step, len(x)), -1) for p in parts]) for k in range(len(names))]
    return [_probabilities(heads[0]), *heads[1:]]


def score(rows: DataFrame, net: Network, curves: str = "tail") -> DataFrame:
    """rows (curves map of channels to values, quality, more) with class, probability and the network's further numbers.

    Only rows of quality ok are scored: all channels there and of one length, else insufficient_samples; a network that fails, or gives no
    finite probabilities, leaves compute_error.
    """
    if found := net.problems():
        raise ValueError("; ".join(found))
    sent = rows.sparkSession.sparkContext.broadcast(net)
    each = F.array(*[F.try_element_at(curves, F.lit(c)) for c in net.channels])
    n = F.size(each[0])
    whole = F.forall(each, lambda v: v.isNotNull() & (F.size(v) == n) & ~F.exists(v, lambda y: y.isNull() | F.isnan(y))) & (n > 0)
    ready = (F.col("quality") == "ok") & F.coalesce(whole, F.lit(False))
    quality = F.when((F.col("quality") == "ok") & ~ready, "insufficient_samples").otherwise(F.col("quality"))
    data = rows.withColumn("_x", F.when(ready, F.flatten(each))).withColumn("quality", quality).drop(curves)
    numbers = [c for head in net.numbers for c in head]

    def scored(batches):
        own = sent.value
        for batch in batches:
            lists = batch.column("_x").cast(pa.large_list(pa.float64()))
            size = np.array([0 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            quality = np.array(batch.column("quality").to_pylist(), object)
            label, p = np.full(batch.num_rows, None, object), np.full(batch.num_rows, np.nan)
            more = {c: np.full(batch.num_rows, np.nan) for c in numbers}
            for k in np.unique(size[size > 0]):
                at = np.flatnonzero(size == k)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), len(own.channels), -1)
                try:
                    first, *rest = predict(own, x)
                    if first.shape[1] != len(own.classes):
                        raise ValueError("another number of classes")
                except Exception:  # the network's own; the rows say so
                    quality[at] = "compute_error"
                    continue
                fine = np.isfinite(first).all(1)
                quality[at[~fine]] = "compute_error"
                at, first = at[fine], first[fine]
                label[at], p[at] = np.array(own.classes, object)[first.argmax(1)], first.max(1)
                for names, y in zip(own.numbers, rest):
                    for j, c in enumerate(names):
                        more[c][at] = y[fine, j]
            out = batch.drop_columns(["_x", "quality"]).append_column("quality", pa.array(quality, pa.string()))
            out = out.append_column("class", pa.array(label, pa.string())).append_column("probability", pa.array(p, mask=np.isnan(p)))
            for c in numbers:
                out = out.append_column(c, pa.array(more[c], mask=np.isnan(more[c])))
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields if f.name not in ("_x", "quality"))
    return data.mapInArrow(scored, f"{kept}, quality string, class string, probability double" + "".join(f", `{c}` double" for c in numbers))


def score_drives(tails: DataFrame, net: Network) -> DataFrame:
    """Tails of drives with fault class and confidence, severity now and at each of HORIZONS: a network of three heads."""
    if tuple(map(len, net.numbers)) != (1, len(HORIZONS)):
        raise ValueError("a network for drives tells one severity now and one for each horizon")
    names = (("severity",), tuple(f"severity_{h}s" for h in HORIZONS))
    own = Network(net.payload, net.channels, net.classes, names, net.scale, net.channels_first)
    out = score(tails, own).withColumnRenamed("class", "fault_type").withColumnRenamed("probability", "confidence")
    return out.withColumns({c: F.round(c, 4) for c in ("confidence", "severity", *names[1])})


def score_press_curves(press: DataFrame, net: Network, points: int) -> DataFrame:
    """press (t, position, velocity, force, more) with verdict, probability, peak force and stroke of each event, at its own time.

    Curves are put at points equal steps of displacement; which of them the network takes, and in which order, its channels say.
    """
    ready = resample_press(press_features(press), points)
    names = ("position", "velocity", "force")
    tail = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"{c}_n") for c in names]))
    quality = F.when((F.col("quality") == "ok") & F.col("position_n").isNull(), "insufficient_samples").otherwise(F.col("quality"))
    ready = ready.withColumn("quality", quality).withColumn("tail", F.when(F.col("quality") == "ok", tail)).drop(*names, *[f"{c}_n" for c in names])
    out = score(ready, net).withColumnRenamed("class", "verdict")
    told = F.col("verdict").isNotNull()
    return out.withColumns({"probability": F.round("probability", 4), "peak_force": F.when(told, F.round("peak_force", 4)), "stroke": F.when(told, F.round("stroke", 4))})
