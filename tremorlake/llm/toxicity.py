"""Toxicity of texts: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a lower-cased text, hashed. Each is scaled by the log ratio
of its smoothed frequencies in texts of either label, and a logistic regression is fitted to all the scaled
features. It is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows of SAMPLE_BYTES together, whole texts, chosen
by a hash of the id. Their counts are added up by Spark over a fixed number of buckets; the sample is dealt to groups of about
GROUP_BYTES, each group fits its weights in one task, and the model has their mean, weighted by rows. A sample of
one group is thus fitted as a whole.

Defined results: a null or empty text has no features and gets the score of the intercept; rows with null
labels, and ids that are null, are not learned from; nor are texts over a sixteenth of SAMPLE_BYTES, which are scored whole like
any other; repeated rows get equal scores and count once in the sample; an id with several labels or texts is learned
as each; ties of the hash go by label and text; without both labels in the sample every score is the share of label 1; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textkit import codepoints, give_back, grams, lean, slices

SAMPLE_ROWS = 12_000
SAMPLE_BYTES, GROUP_BYTES = 40 << 20, 10 << 20
SIZES = (3, 4, 5)
BITS = 20
#: Features that a step of the fit takes at a time.
RUN = 1 << 20
STEPS, RATE, PENALTY = 60, 0.02, 0.01


def split_of(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, id_col: str, text_col: str, rows: int, size: int, cost: Column | None = None) -> DataFrame:
    """(id, text, y, upto) of at most rows labelled rows of size together that held leaves for training, chosen by a hash of the id.

    The size of a row is cost, by default the bytes of its text; rows over a sixteenth of size are left out. upto is the
    size of all chosen rows up to this one, itself included. Rows equal in id, label and text count once.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held)
    chosen = chosen.distinct().orderBy(F.xxhash64("id"), "y").limit(rows)
    met = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    met = met.withColumn("h", F.xxhash64("text"))
    cost = F.octet_length("text") + 1 if cost is None else cost
    keys = met.select("id", "y", "h", cost.cast("long").alias("n")).where(F.col("n") <= size // 16).groupBy("id", "y", "h").agg(F.min("n").alias("n"))
    keys = keys.orderBy(F.xxhash64("id"), "y", "h").limit(rows)
    keys = keys.withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("id"), "y", "h"))).where(F.col("upto") <= size)
    return met.join(F.broadcast(keys.drop("n")), ["id", "y", "h"]).dropDuplicates(["id", "y", "h"]).select("id", "text", "y", "upto")


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct n-grams of each text, in order."""
    cps, at = codepoints([f" {t.lower()}" for t in texts], " ")
    cps = np.where(cps == 10, 32, cps).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, np.diff(at))
    found = [np.zeros(0, np.int64)]
    for n in SIZES:
        g = grams(cps, n, BITS)
        inner = np.ones(len(g), bool)
        for j in range(1, n):
            leaves = at[1:] - j
            inner[leaves[(leaves >= 0) & (leaves < len(g))]] = False
        found.append((owner[: len(g)] | g)[inner])
    keys = np.concatenate(found)
    keys.sort()
    keys = keys[np.diff(keys, prepend=-1) != 0]
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of either label by bucket, and in all."""

    def counted(batches):
        counts, total = np.zeros((1 << BITS) * 2, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                y = part.column("y").to_numpy()
                row, bucket = _features(part.column("text").to_pylist())
                counts += np.bincount(bucket * 2 + y[row], minlength=len(counts))
                total += np.bincount(y, minlength=2)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([counts[at], total]))], ["key", "n"])

    def packed(rows: pa.Table) -> pa.Table:
        # a few wide rows are lighter to the driver than one a bucket
        return pa.table({"keys": [rows["key"].to_numpy().astype(np.int32).tobytes()], "n": [rows["n"].to_numpy().tobytes()]})

    summed = sample.select("text", "y").mapInArrow(lean(counted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts, total = np.zeros((1 << BITS) * 2, np.int64), np.zeros(2, np.int64)
    for r in summed.groupBy(F.shiftright("key", 14).alias("wide")).applyInArrow(packed, "keys binary, n binary").collect():
        key, n = np.frombuffer(r.keys, np.int32), np.frombuffer(r.n, np.int64)
        counts[key[key >= 0]] = n[key >= 0]
        total[-1 - key[key < 0]] = n[key < 0]
    return counts.reshape(-1, 2), total


def _logistic(size: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse rows of size features each, by Adam on the whole of it.

    A feature's value is the scale of its bucket. Steps go over RUN features at a time, so that scratch does not grow with col.
    """
    w, b = np.zeros(len(scale), np.float32), prior
    m, v = np.zeros(len(scale) + 1, np.float32), np.zeros(len(scale) + 1, np.float32)
    full = np.flatnonzero(size)
    end = np.cumsum(size)[full]
    begin = end - size[full]
    runs = []
    for at in range(0, len(col), RUN):
        to = min(at + RUN, len(col))
        rows = slice(*np.searchsorted(end, [at, at + RUN - 1], "right") + [0, 1])
        runs.append((col[at:to], full[rows], np.maximum(begin[rows], at) - at, np.minimum(end[rows], to) - np.maximum(begin[rows], at)))
    for step in range(1, STEPS + 1):
        z, scaled = np.full(len(y), b), scale * w
        for part, row, first, _ in runs:
            z[row] += np.add.reduceat(scaled[part], first, dtype=np.float64)
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        met = np.zeros(len(scale))
        for part, row, _, n in runs:
            met += np.bincount(part, np.repeat(off[row], n), len(scale))
        g = np.append((scale * met).astype(np.float32) + PENALTY * w, np.float32(off.sum()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - d[:-1], b - float(d[-1])
    return w, b


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each bucket, and the intercept, from rows (text, y, upto)."""
    counts, total = _counts(sample)
    if not total.all():
        share = total[1] / total.sum() if total.sum() else 0.0
        return np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    ratio = (np.log((counts[:, 1] + 1) / (total[1] + 2)) - np.log((counts[:, 0] + 1) / (total[0] + 2))).astype(np.float32)
    del counts
    prior = float(np.log(total[1] / total[0]))
    sent = sample.sparkSession.sparkContext.broadcast(ratio)

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("upto")
        # room for an n-gram of each size at every byte; what stays unused takes no memory
        size, col, at = [], np.empty(len(SIZES) * (rows["text"].nbytes + 2 * rows.num_rows), np.int32), 0
        for part in slices(rows, "text"):
            row, bucket = _features(part.column("text").to_pylist())
            size.append(np.bincount(row, minlength=part.num_rows))
            col[at : at + len(bucket)] = bucket
            at += len(bucket)
        w, b = _logistic(np.concatenate(size), col[:at], sent.value, rows["y"].to_numpy().astype(float), prior)
        del size, col
        give_back()
        return pa.table({"n": [rows.num_rows], "b": [b], "w": [(w * sent.value).tobytes()]})

    dealt = sample.select("text", "y", "upto", F.floor((F.col("upto") - 1) / GROUP_BYTES).alias("g"))
    fitted = dealt.groupBy("g").applyInArrow(group, "n long, b double, w binary").collect()
    sent.destroy()
    n, weight = sum(r.n for r in fitted), np.zeros(1 << BITS, np.float32)
    for r in fitted:
        weight += np.frombuffer(r.w, np.float32) * np.float32(r.n / n)
    b = sum(r.b * r.n / n for r in fitted)
    del fitted
    give_back()
    return weight, b


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1; docs may have any columns but name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        weight, b = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                row, bucket = _features([t or "" for t in part.column(text_col).to_pylist()])
                z = np.bincount(row, weight[bucket], part.num_rows) + b
                yield part.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))))

    return docs.mapInArrow(lean(scored), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", parts: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted): trained on labelled rows whose crc32(id as text) mod parts is not held."""
    out_of = F.coalesce(split_of("id", parts) == held, F.lit(False))
    model = fit(labelled_sample(docs, labels, label, out_of, id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES))
    rows = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return rows.select(F.col("id").alias(id_col), out_of.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
