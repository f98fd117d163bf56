"""Token counts of the documents in flat token files that have no index, by a separator scan.

A flat file is the token ids of one document after another, each ended by an end-of-document id, cut into
blocks of a fixed number of tokens wherever that falls. Each block is searched for the end id at once; what
a block does not know, the tokens and documents before it and where the last document before it
ended, is a prefix scan over one small row a block, first over groups of GROUP blocks and then within
them, so that even a single huge file is not one task's window.

Defined results: an empty document has no tokens; tokens after the last end id are a document of their own that
is not ended; a null text is an empty document; rows without id keep a null id; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .textkit import slices

BLOCK_TOKENS = 1 << 16
GROUP = 1024
_LOADED: dict = {}


def byte_encoder(path: str):
    """encode_ordinary of a byte-level BPE whose ranks stand in path."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _LOADED[path]


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 50256, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of docs: rows (file, block, payload) of 16-bit ids, and rows (file, nth, ids) with the
    ids of the documents from the nth on, in the order of the file; one file for each partition."""
    if end_id > 0xFFFF:
        raise ValueError("ids must fit 16 bits")
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("nth", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def rows(batches):
        encode, file = byte_encoder(tokenizer), TaskContext.get().partitionId()
        rest, block, nth = np.zeros(0, np.uint16), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [np.array([*encode(t or ""), end_id], np.uint16) for t in texts]
                rest = np.concatenate([rest, *ids])
                full = len(rest) // block_tokens
                out = [{"file": file, "nth": nth, "ids": part.column("id").to_pylist()}]
                out += [{"file": file, "block": block + k, "payload": rest[k * block_tokens : (k + 1) * block_tokens].tobytes()} for k in range(full)]
                rest, block, nth = rest[full * block_tokens :], block + full, nth + len(texts)
                yield pa.RecordBatch.from_pylist(out, schema)
        if len(rest):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "payload": rest.tobytes()}], schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(rows, "file long, block long, payload binary, nth long, ids array<long>")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """(file, block, payload) of flat files, up to 2 GB each, in a folder; file is the hash of the path."""
    whole = spark.read.format("binaryFile").load(path).where("length > 0").select(F.xxhash64("path").alias("file"), "content", "length")
    last = F.ceil(F.col("length") / block_bytes).cast("int") - 1
    cut = whole.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    return cut.select("file", F.col("block").cast("long"), F.substring(F.col("content"), F.col("block") * block_bytes + 1, F.lit(block_bytes)).alias("payload"))


def _before(values: Column, part: list, order: str) -> Column:
    return values.over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def token_counts(blocks: DataFrame, end_id: int = 50256, width: int = 2) -> DataFrame:
    """(file, nth, start, n_tokens, ended) of every document in blocks (file, block, payload); n_tokens without the end id."""

    def scanned(batches):
        for batch in batches:
            ids = [np.frombuffer(p or b"", "<u2" if width == 2 else "<u4") for p in batch.column("payload").to_pylist()]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            off = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = np.concatenate(ends).astype(np.int32) if ends else np.zeros(0, np.int32)
            size = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), size, pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["file", "block", "size", "ends"])

    each = blocks.select("file", "block", "payload").mapInArrow(scanned, "file long, block long, size long, ends array<int>")
    each = each.withColumn("grp", F.expr(f"block div {GROUP}")).withColumn("n", F.size("ends").cast("long"))
    zero = F.lit(0).cast("long")
    groups = each.groupBy("file", "grp").agg(F.sum("size").alias("gs"), F.sum("n").alias("gn"))
    groups = groups.select("file", "grp", *[F.coalesce(_before(F.sum(c), ["file"], "grp"), zero).alias(f"{c}0") for c in ("gs", "gn")])
    each = each.join(groups, ["file", "grp"])
    each = each.withColumn("at", F.col("gs0") + F.coalesce(_before(F.sum("size"), ["file", "grp"], "block"), zero))
    each = each.withColumn("nth", F.col("gn0") + F.coalesce(_before(F.sum("n"), ["file", "grp"], "block"), zero))
    each = each.withColumn("last", F.when(F.col("n") > 0, F.col("at") + F.element_at("ends", -1)))
    lasts = each.groupBy("file", "grp").agg(F.max("last").alias("l"))
    lasts = lasts.select("file", "grp", _before(F.max("l"), ["file"], "grp").alias("l0"))
    each = each.join(lasts, ["file", "grp"])
    each = each.withColumn("prev", F.coalesce(F.greatest(F.col("l0"), _before(F.max("last"), ["file", "grp"], "block")), F.lit(-1).cast("long")))
    docs = each.select("file", "at", "nth", "prev", "ends", F.posexplode("ends").alias("j", "end"))
    begin = F.when(F.col("j") > 0, F.col("at") + F.get("ends", F.col("j") - 1)).otherwise(F.col("prev")) + 1
    docs = docs.select("file", (F.col("nth") + F.col("j")).alias("nth"), begin.alias("start"), (F.col("at") + F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("ended"))
    files = each.groupBy("file").agg(F.sum("size").alias("size"), F.sum("n").alias("nth"), (F.coalesce(F.max("last"), F.lit(-1).cast("long")) + 1).alias("start"))
    open_end = files.where("size > start").select("file", "nth", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.union(open_end)


def document_token_counts(files: DataFrame, end_id: int = 50256) -> DataFrame:
    """(id, n_tokens) of the documents of token_files."""
    ids = files.where("ids IS NOT NULL").select("file", F.col("nth").alias("first"), F.posexplode("ids").alias("k", "id"))
    ids = ids.select("file", (F.col("first") + F.col("k")).alias("nth"), "id")
    return token_counts(files.where("payload IS NOT NULL"), end_id).join(ids, ["file", "nth"]).select("id", "n_tokens")
