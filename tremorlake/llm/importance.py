"""Importance resampling towards a target distribution, on hashed n-grams.

The n-grams of a batch are interned in an open-addressed table of numpy arrays: every occurrence is hashed by 64-bit
xxHash, probes linearly from its hash's slot, claims the first free one or joins the n-gram that holds it once the bytes
of the two have been compared, and so has the id of a slot. Slots hold an n-gram's bucket and count. Counts by bucket are summed
over all documents and all target texts; with the gain of each bucket set in the slots, occurrences gather their gains by slot id.

Documents are ranked by weight plus Gumbel noise from a hash of seed and id, which draws without replacement in
proportion to exp(weight / 1000). Ranks are exact: rows are range-partitioned by score, numbered within partitions and
shifted by the sizes of the partitions before. Rows that an estimated quantile shows to be past the draw are left out of that sort
only after a count has shown that enough are before it.

Bounds: the driver holds two counts and a gain for each of `buckets` buckets, whatever the corpus.

Defined results: null and wordless texts have no features and weight 0; null ids hash as the seed alone and rank after others of the
same score; repeated rows are documents of their own, each counted and ranked; ties go to the smaller id; with an
empty target all gains come from the documents' counts; empty documents give an empty result; texts of any length count
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import spread, written
from .textkit import PLAIN, U, as_bytes, slices

SLICE_BYTES = 4 << 20
A_RANGE = 1_000_000
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)  # masks of the first k bytes
LONG = 256


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


class Runs:
    """Runs of 1 to max_n words of a column of texts, as byte ranges of its lower-cased words joined by one space.

    start and end of each run, and text, the row that it stands in, in order of rows.
    """

    def __init__(self, texts: pa.Array, max_n: int):
        data, bounds = as_bytes(texts)
        data = np.frombuffer(data.tobytes().translate(PLAIN), np.uint8)
        blank = data == 0x20
        again = np.zeros(len(data), bool)
        again[1:] = blank[1:] & blank[:-1]
        kept = np.concatenate([[0], np.cumsum(~again)])
        data, blank, bounds = data[~again], blank[~again], kept[bounds]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner], after[inner - 1] = True, True
        first, last = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        row = np.searchsorted(bounds, first, "right") - 1
        self.words = np.bincount(row, minlength=len(texts)).astype(np.int64)
        start, end, text = [first], [last], [row]
        for n in range(2, max_n + 1):
            m = max(0, len(first) - n + 1)
            whole = row[:m] == row[n - 1 : n - 1 + m]
            start.append(first[:m][whole])
            end.append(last[n - 1 : n - 1 + m][whole])
            text.append(row[:m][whole])
        self.start, self.end, self.text = (np.concatenate(x) for x in (start, end, text))
        if max_n > 1:
            order = np.argsort(self.text, kind="stable")
            self.start, self.end, self.text = self.start[order], self.end[order], self.text[order]
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, "<u8", self.data, 0, (1,))  # the eight bytes from each byte on
        self.four = np.ndarray(len(data) + 1, "<u4", self.data, 0, (1,))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hashes(runs: Runs) -> np.ndarray:
    """64-bit xxHash of each run: those under 32 bytes all at once, the others one by one."""
    start, size = runs.start, runs.end - runs.start
    with np.errstate(over="ignore"):
        h = _P5 + size.astype(U)
        at = start.copy()
        for k in range(3):
            i = np.flatnonzero(size >= 8 * (k + 1))
            lane = _rotl(runs.eight[at[i]] * _P2, 31) * _P1
            h[i] = _rotl(h[i] ^ lane, 27) * _P1 + _P4
            at[i] += 8
        i = np.flatnonzero(size % 8 >= 4)
        i = i[size[i] < 32]
        h[i] = _rotl(h[i] ^ (runs.four[at[i]].astype(U) * _P1), 23) * _P2 + _P3
        at[i] += 4
        for k in range(3):
            i = np.flatnonzero(size % 4 > k)
            i = i[size[i] < 32]
            h[i] = _rotl(h[i] ^ (runs.data[at[i]].astype(U) * _P5), 11) * _P1
            at[i] += 1
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        h ^= h >> U(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(runs.data[start[i] : start[i] + size[i]])
    return h


def same_bytes(runs: Runs, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the runs a and b have the same bytes."""
    size = runs.end[a] - runs.start[a]
    same = size == runs.end[b] - runs.start[b]
    one, other = runs.start[a], runs.start[b]
    for at in range(0, LONG, 8):
        i = np.flatnonzero(same & (size > at) & (size <= LONG))
        if not len(i):
            break
        part = _LOW[np.minimum(size[i] - at, 8)]
        same[i] = (runs.eight[one[i] + at] ^ runs.eight[other[i] + at]) & part == 0
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        same[i] = np.array_equal(runs.data[one[i] : one[i] + size[i]], runs.data[other[i] : other[i] + size[i]])
    return same


class Table:
    """Open-addressed table of the distinct runs of a batch, at most half full.

    slot: of each run; owner, bucket and count: of each slot, owner being a run that holds it or -1.
    """

    def __init__(self, runs: Runs, buckets: int, keys: np.ndarray | None = None):
        keys = hashes(runs) if keys is None else keys
        n = len(keys)
        size = 1 << max(3, (2 * n - 1).bit_length())
        self.owner = np.full(size, -1, np.int64)
        self.slot = (keys & U(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = self.slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that claim a slot one stays
            holder = self.owner[at]
            match = holder == left
            maybe = np.flatnonzero(~match & (keys[holder] == keys[left]))
            match[maybe] = same_bytes(runs, left[maybe], holder[maybe])
            left = left[~match]
            self.slot[left] = (self.slot[left] + 1) & (size - 1)
        self.used = np.flatnonzero(self.owner >= 0)
        self.bucket, self.count = np.zeros(size, np.int64), np.bincount(self.slot, minlength=size)
        raw, of = runs.data.tobytes(), self.owner[self.used]
        self.bucket[self.used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(runs.start[of].tolist(), runs.end[of].tolist())]


def bucket_counts(texts: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """Occurrences of n-grams by bucket in all texts: each task sends a count for each bucket at most."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                t = Table(Runs(part.column("text"), max_n), buckets)
                np.add.at(total, t.bucket[t.used], t.count[t.used])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select(F.col(text_col).alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, p and q being its add-one shares of the target's and the documents' features."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    each = [math.floor(1000 * math.log((t + 1) * of_source / ((s + 1) * of_target))) for s, t in zip(map(float, source), map(float, target))]
    return np.array(each, np.int64)


def noise(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, max_n: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of docs (id, text)."""
    buckets = len(gains)

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                runs, n = Runs(part.column("text"), max_n), part.num_rows
                t = Table(runs, buckets)
                gain = np.zeros(len(t.owner), np.int64)
                gain[t.used] = gains[t.bucket[t.used]]
                of = np.concatenate([[0], np.cumsum(gain[t.slot])])
                cut = np.searchsorted(runs.text, np.arange(n + 1))
                weight = np.diff(of[cut])
                drawn = [noise(int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)) for k in part.column("id").to_pylist()]
                columns = [part.column("id"), pa.array(runs.words), pa.array(np.diff(cut)), pa.array(weight), pa.array(weight + np.array(drawn, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, able: Column, percent: int) -> DataFrame:
    """rows (row, id, score, more) with rank, 1 for the highest score on, for the percent of the able rows that are drawn; null for others.

    row must be a number of its own for each row, that stays the same whenever rows are read.
    """
    key = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    most = percent * rows.where(able).count() // 100
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    bound = rows.where(able).agg(F.percentile_approx("score", max(0.0, 1 - percent / 80), 1000)).first()[0]
    top = rows.where(able & (F.col("score") >= bound))
    n = top.count()
    if n < most:
        top, n = rows.where(able), rows.where(able).count()
    top = top.repartitionByRange(spread(n, A_RANGE), key).sortWithinPartitions(key)
    top = written(top.withColumn("spot", F.monotonically_increasing_id()), "ranked").withColumn("part", F.shiftright("spot", 33))
    sizes = top.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    top = top.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("spot").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    last = top.where(F.col("rank") == most).select("score", "id", "row").first()
    cut = F.struct(F.lit(-last.score).cast("long"), F.lit(last.id is None), F.lit(last.id).cast(rows.schema["id"].dataType), F.lit(last.row).cast("long"))
    rest = rows.where(~able | (key > cut)).withColumn("rank", F.lit(None).cast("long"))
    return top.where(F.col("rank") <= most).select(rest.columns).union(rest)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    max_n: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank): of the documents with min_words words or more, percent are drawn and ranked from 1."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gains = gains_of(bucket_counts(own, "text", max_n, buckets), bucket_counts(target, target_text_col, max_n, buckets))
    rows = written(scored(own, gains, max_n, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    out = ranked(rows, F.col("n_words") >= min_words, percent)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
