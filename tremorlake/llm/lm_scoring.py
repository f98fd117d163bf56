"""Stupid-backoff language-model scores of documents, from n-gram counts of the whole corpus.

Three relations, whose rows are packed blocks of n-grams partitioned by hash: the n-grams of the corpus, exploded, by chunk of documents and
hash bucket; the count table, by hash bucket, made by adding up the exploded n-grams of each bucket; and the join of the count table to
the exploded n-grams on the bucket, which gives each chunk the counts of its n-grams. Scores are summed per document. The
count table holds n-grams that occur twice or more: one of the corpus that it lacks occurs once. Single words and pairs are counted
first; of longer n-grams only those are exploded whose two shorter ones both occur twice or more, as no other can.

A word's score is the relative frequency of the longest n-gram with at least min_count occurrences that ends at it, single words always,
times alpha for each step of backing off. With min_count 1 no n-gram of the scored corpus is unseen, so that nothing would back
off; by default an n-gram must occur at another place, too.

Keys of a block are sorted, stored as differences in planes of bytes, and compressed; a frequent n-gram is one entry a chunk. Chunks are
runs of rows of a bounded number of bytes, so rows that repeat do not gather in one. Their numbers come from where rows are read, so
input that is not a plain read of stored files is written first: made again, a chunk then holds the same texts.

Defined results: null text or no words, no score (null) and zero words; the first words of a document
use the contexts they have; repeated rows count twice and score alike; ties do not arise, as every word has one longest n-gram; an empty
table gives an empty result; other columns are ignored, whatever their names. N-grams of equal 64-bit hash share a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import repeatable
from .textkit import U, Words, as_bytes, slices

CHUNK_BYTES = 6 << 20
TEXT_LEVEL = 6
KEYS_A_BUCKET = 400_000
_MANY = 255


def _squeezed(*parts: np.ndarray, level: int = 1) -> bytes:
    raw = b"".join(x.tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def _loosened(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in planes of bytes: those of high places are nearly all zero."""
    return _squeezed(np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T)


def unpacked_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_loosened(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of _MANY or more stand behind, in eight."""
    return _squeezed(np.array([len(counts)]), np.minimum(counts, _MANY).astype(np.uint8), counts[counts >= _MANY].astype(np.int64))


def unpacked_counts(raw: bytes) -> np.ndarray:
    body = _loosened(raw)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    counts = np.frombuffer(body, np.uint8, n, 8).astype(np.int64)
    counts[counts == _MANY] = np.frombuffer(body, np.int64, offset=8 + n)
    return counts


def _summed(keys: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they occur."""
    if held is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[new], np.add.reduceat(held[order], new) if len(new) else held


class _Grams:
    """One chunk's words and the n-grams that begin at each, None where they leave their text."""

    def __init__(self, rows: pa.Table, order: int):
        sizes = np.concatenate([np.array(x, np.int64) for x in rows["sizes"].to_pylist()])
        off = np.concatenate([[0], np.cumsum(sizes)])
        body = b"".join(_loosened(x) for x in rows["texts"].to_pylist())
        texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(body)])
        self.words = Words(texts, lower=True)
        sizes = np.diff(self.words.off)
        self.nth = np.arange(len(self.words.hash)) - np.repeat(self.words.off[:-1], sizes)
        left = np.repeat(sizes, sizes) - self.nth
        self.keys = [(np.flatnonzero(left >= n), self.words.windows(n)) for n in range(1, order + 1)]

    def counts(self, rows: pa.Table, order: int) -> list[np.ndarray]:
        """By length up to order, how often the n-gram that begins at each word occurs in the corpus (0 where none does), from joined rows."""
        out = []
        for level in range(2, max(2, order) + 1):
            own = rows.filter(pc.equal(rows["level"], level)).sort_by("bucket")
            total = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(x) for x in own["total"].to_pylist())])
            asked = self.asked(level, out)
            known, _ = _summed(np.concatenate([w for _, w in asked]))
            for at, w in asked[: order if level == 2 else None]:
                c = np.zeros(len(self.nth), np.int64)
                if level > 2:
                    c[self.keys[level - 1][0]] = 1  # those not asked for
                c[at] = total[np.searchsorted(known, w)]
                out.append(c)
        return out

    def asked(self, level: int, counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(where it begins, key) of the n-grams of a level: 2 has single words and pairs, others the n-grams that may occur twice."""
        if level == 2:
            return [(at, w[at]) for at, w in self.keys[:2]]
        at, w = self.keys[level - 1]
        at = at[(counts[level - 2][at] > 1) & (counts[level - 2][at + 1] > 1)]
        return [(at, w[at])]


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, sizes, texts): runs of rows with compressed texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        nth = TaskContext.get().partitionId() << 34
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                data, off = as_bytes(part.column("text"))
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nth]), pa.ListArray.from_arrays(one, part.column("id")), pa.ListArray.from_arrays(one, pa.array(np.diff(off))), pa.array([_squeezed(data, level=TEXT_LEVEL)], pa.binary())],
                    ["chunk", "ids", "sizes", "texts"],
                )
                nth += 1

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(rows, f"chunk long, ids array<{kind}>, sizes array<long>, texts binary")


_EXPLODED = "chunk long, bucket long, keys binary, held binary"
_JOINED = "chunk long, bucket long, level int, total binary"
_EXPLODED_ROWS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("held", pa.binary())])


def _exploded(chunks: DataFrame, joined: DataFrame | None, level: int, order: int, buckets: int) -> DataFrame:
    """(chunk, bucket, keys, held): the distinct n-grams of each chunk by bucket of their hash, and how often it has them."""

    def rows_of(chunk: int, asked: list) -> pa.Table:
        keys, held = _summed(np.concatenate([w for _, w in asked]))
        bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # in the order of the keys
        cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(keys)]
        out = [{"chunk": chunk, "bucket": int(bucket[a]), "keys": packed_keys(keys[a:b]), "held": packed_counts(held[a:b])} for a, b in zip(cut, cut[1:])]
        return pa.Table.from_pylist(out, _EXPLODED_ROWS)

    if joined is None:
        return chunks.groupBy("chunk").applyInArrow(lambda rows: rows_of(rows["chunk"][0].as_py(), _Grams(rows, min(order, 2)).asked(2, [])), _EXPLODED)

    def longer(rows: pa.Table, found: pa.Table) -> pa.Table:
        grams = _Grams(rows, level)
        return rows_of(rows["chunk"][0].as_py(), grams.asked(level, grams.counts(found, level - 1)))

    return chunks.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(longer, _EXPLODED)


def _count_table(exploded: DataFrame) -> DataFrame:
    """(bucket, known, total): the n-grams of each bucket that occur twice or more in the corpus, and how often."""
    schema = pa.schema([("bucket", pa.int64()), ("known", pa.binary()), ("total", pa.binary())])

    def count(rows: pa.Table) -> pa.Table:
        keys, total = _summed(np.concatenate([unpacked_keys(x) for x in rows["keys"].to_pylist()]), np.concatenate([unpacked_counts(x) for x in rows["held"].to_pylist()]))
        often = total > 1
        return pa.table([[rows["bucket"][0].as_py()], [packed_keys(keys[often])], [packed_counts(total[often])]], schema=schema)

    return exploded.groupBy("bucket").applyInArrow(count, "bucket long, known binary, total binary")


def _joined(exploded: DataFrame, counts: DataFrame, level: int) -> DataFrame:
    """(chunk, bucket, level, total): exploded n-grams with their counts in the corpus, in the order of their keys."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("total", pa.binary())])

    def join(rows: pa.Table, table: pa.Table) -> pa.Table:
        known, total = unpacked_keys(table["known"][0].as_py()), unpacked_counts(table["total"][0].as_py())
        found = []
        for raw in rows["keys"].to_pylist():
            keys = unpacked_keys(raw)
            n = np.ones(len(keys), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                n = np.where(known[at] == keys, total[at], 1)
            found.append(packed_counts(n))
        return pa.table([rows["chunk"], rows["bucket"], pa.array([level] * len(found), pa.int32()), found], schema=schema)

    return exploded.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(join, _JOINED)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2, stored: bool = False) -> DataFrame:
    """(id_col, n_words, n_backed_off, log10_score, mean_log10): words are runs without ASCII white space, A-Z lower-cased.

    stored: docs is a plain read of stored files; other input is written first, as its chunks are made more than once.
    """
    docs = repeatable(docs.select(id_col, text_col), "texts", stored)
    text = F.col(text_col)
    size, words = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), F.lit(0))).first()
    chunks = _chunks(docs, id_col, text_col)
    buckets, joined = max(1, size // 4 // KEYS_A_BUCKET), None
    for level in range(2, max(2, order) + 1):
        exploded = _exploded(chunks, joined, level, order, buckets)
        found = _joined(exploded, _count_table(exploded), level)
        joined = found if joined is None else joined.unionByName(found)

    def scored(rows: pa.Table, found: pa.Table) -> pa.Table:
        grams = _Grams(rows, order)
        n, counts = len(grams.nth), []  # by length, of the n-gram that ends at each word; 0 if it does not count
        for k, begins in enumerate(grams.counts(found, order), 1):
            c = np.zeros(n, np.int64)
            c[k - 1 :] = begins[: max(0, n - k + 1)]
            c[grams.nth < k - 1] = 0
            counts.append(c if k == 1 else np.where(c >= min_count, c, 0))
        most = np.minimum(grams.nth + 1, order)
        log = np.log10(np.maximum(counts[0], 1) / max(words, 1))
        used = np.ones(n, np.int64)
        for k in range(2, order + 1):
            before = np.ones(n, np.int64)
            before[1:] = counts[k - 2][:-1]
            hit = counts[k - 1] > 0
            log[hit] = np.log10(counts[k - 1][hit] / np.maximum(before[hit], 1))
            used[hit] = k
        log += (most - used) * np.log10(alpha)
        off = grams.words.off
        sums = np.diff(np.concatenate([[0], np.cumsum(log)])[off])
        backed = np.diff(np.concatenate([[0], np.cumsum(used < most)])[off])
        n_words = np.diff(off)
        none = n_words == 0
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums / n_words
        ids = rows["ids"].combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        return pa.table(
            [ids, pa.array(n_words.astype(np.int64)), pa.array(backed.astype(np.int64)), pa.array(sums, mask=none), pa.array(mean, mask=none)],
            names=["id", "n_words", "n_backed_off", "log10_score", "mean_log10"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    out = chunks.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(scored, f"id {kind}, n_words long, n_backed_off long, log10_score double, mean_log10 double")
    return out.withColumnRenamed("id", id_col)
