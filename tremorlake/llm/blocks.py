"""Asking a whole corpus about 64-bit keys, in packed blocks.

Documents are dealt to chunks of at most about a megabyte or a few, as they are read. A chunk asks about its distinct keys,
cut by hash into buckets; a bucket adds up what all chunks hold and answers each with its keys that
reach a total. A key leaves a chunk once however often it occurs there. Chunks do not grow with the corpus, their
number does; buckets do not either but for keys of most chunks, of which a bucket gets one entry a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import repeatable
from .textkit import U, lean, slices

KEYS_A_BUCKET = 400_000
ASK = "chunk long, bucket long, keys binary, held binary"
REPLY = "chunk long, bucket long, keys binary, total binary"
_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("total", pa.binary())])
_MANY = 255


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of _MANY or more stand behind, in eight."""
    return np.minimum(counts, _MANY).astype(np.uint8).tobytes() + counts[counts >= _MANY].astype(np.int64).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == _MANY] = np.frombuffer(raw, np.int64, offset=n)
    return counts


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, keep: tuple = (), stored: bool = False) -> tuple[DataFrame, int]:
    """docs as (id, text, keep..., chunk) and the bytes of all texts.

    A chunk is a run of rows as they are read, of one Arrow batch and chunk_bytes of text at most or one longer text, so equal
    rows, and rows of nulls, spread like any others. stored: docs is a plain read of stored files; other input is written first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = repeatable(rows, "rows", stored)
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0

    def numbered(batches):
        nth = TaskContext.get().partitionId() << 34
        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, nth))], [*part.schema.names, "chunk"])
                nth += 1

    return rows.mapInArrow(lean(numbered), StructType([*rows.schema.fields, StructField("chunk", LongType())])), total


def asked(chunk: int, keys: np.ndarray, buckets: int) -> list[dict]:
    """Rows of ASK for the keys of one chunk, repeats included."""
    keys, held = np.unique(keys, return_counts=True)
    bucket = ((keys >> U(20)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, held = bucket[order], keys[order], held[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(keys)]
    return [{"chunk": chunk, "bucket": int(bucket[a]), "keys": keys[a:b].tobytes(), "held": _packed(held[a:b])} for a, b in zip(cut, cut[1:])]


def replies(ask: DataFrame, least: int, echo: bool = True) -> DataFrame:
    """To every asking chunk and bucket, what all chunks together hold of its keys.

    With echo, the keys that they hold least times, with the totals: read by answer(). Without, the totals of all its keys in
    the order asked, 0 for those under least: read by totals().
    """

    def bucket(rows: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, U) for x in rows["keys"].to_pylist()]
        keys = np.concatenate(blocks)
        held = np.concatenate([_unpacked(x, len(b)) for x, b in zip(rows["held"].to_pylist(), blocks)])
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        sums = np.add.reduceat(held[order], new)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(new, len(keys))))
        out, at = {"chunk": [], "bucket": [], "keys": [], "total": []}, 0
        for c, k, b in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), blocks):
            t = total[at : at + len(b)]
            at += len(b)
            live = t >= least
            if live.any() or not echo:
                out["chunk"].append(c)
                out["bucket"].append(k)
                out["keys"].append(b[live].tobytes() if echo else None)
                out["total"].append(_packed(t[live] if echo else np.where(live, t, 0)))
        return pa.table(out, schema=_REPLY)

    return ask.groupBy("bucket").applyInArrow(bucket, REPLY)


def answer(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys that a chunk was answered, in order, with their totals."""
    blocks = [np.frombuffer(x, U) for x in rows["keys"].to_pylist()]
    keys = np.concatenate([np.zeros(0, U), *blocks])
    total = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x, len(b)) for x, b in zip(rows["total"].to_pylist(), blocks))])
    order = np.argsort(keys)
    return keys[order], total[order]


def totals(asked_rows: list[dict], rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a chunk asked for, in order, with their totals, from replies without echo."""
    of = dict(zip(rows["bucket"].to_pylist(), rows["total"].to_pylist()))
    blocks = [(np.frombuffer(r["keys"], U), of[r["bucket"]]) for r in asked_rows]
    keys = np.concatenate([np.zeros(0, U), *(k for k, _ in blocks)])
    total = np.concatenate([np.zeros(0, np.int64), *(_unpacked(t, len(k)) for k, t in blocks)])
    order = np.argsort(keys)
    return keys[order], total[order]


def found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ones."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys
