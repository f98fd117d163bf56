"""Packing of tokenised documents into windows of bounded length by multiway differencing.

A document's ids are cut at every multiple of the capacity, and the rest into halves of halves: down to an eighth of the
capacity, and to FINE_FLOOR ids where the rests so far have filled another window, so that each window has about one
document's small pieces to be levelled with, whatever the lengths of documents are. Whole pieces are windows by
themselves; the others go to batches of bounded size, and each batch is split into k windows by the largest differencing
method of Karmarkar and Karp: every piece begins as a partition of its own with one filled part, and
the two partitions of the largest spread are merged again and again, the fullest part of one with
the emptiest of the other. k begins at the least number that could hold the tokens and rises whenever a
window exceeds the capacity, to the first number found by doubled steps and bisection that fits. What a batch
pads is then mostly its last window's share, so a batch has WINDOWS_A_BATCH windows or more unless it reaches MOST_PIECES.

Pieces are written and counted first, so that the size of batches is bounded however many documents or ids there
are; the ids themselves never leave the task that made them unless a caller keeps their column.

Defined results: a null text is empty, so its document is the end id alone; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import written
from .textkit import codepoints, lean, slices

#: A batch: pieces wanted, windows wanted, and pieces at most.
PIECES_A_BATCH, WINDOWS_A_BATCH, MOST_PIECES = 3000, 200, 60_000
#: Parts whose ids a task keeps, characters of a part worth keeping, and characters that are encoded at a time.
CACHED_PARTS, CACHED_CHARS = 400_000, 64
RUN_CHARS = 1 << 20
#: Ids of the smallest pieces, and how many of the larger ones a window takes at least.
FINE_FLOOR, COARSE_PARTS = 8, 8
_GAP = re.compile("[ \t-\r]")
_ODD = re.compile("[\x00-\x1f'<\x7f-\xa0\xad\u0130\u0180-\U0010ffff]")

#: The steps of a tokenizer that works on parts of white-space words, as its file names them.
NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"


@cache
def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point (0 white space, 1 letter, 2 digit, 3 other, 4 not plain) and its lower case.

    Plain are those up to U+017F on whose kind and lower case all versions of Unicode agree; an apostrophe is not, as it may
    begin a contraction.
    """
    kind = np.full(0x110000, 4, np.uint8)
    low = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x180):
        c = chr(cp)
        sort = unicodedata.category(c)
        if 0x09 <= cp <= 0x0D or cp == 0x20:
            kind[cp] = 0
        elif not (sort[0] in "CZ" or c in "'\u0130"):
            kind[cp] = 1 if sort[0] == "L" else 2 if sort[0] == "N" else 3
            low[cp] = ord(c.lower())
    return kind, low


def _by_parts(path: str) -> bool:
    """Whether the tokenizer's ids of a text are those of its white-space words, and of these the letter runs, digits and other runs."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    cut = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [(x["type"], x.get("pattern", {}).get("Regex")) for x in steps] == NORMALIZER
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"].get("Regex"), cut[0]["behavior"], cut[0]["invert"]) == (SPLIT, "Removed", True)
        and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"])
        and (made["model"]["type"], made["model"].get("end_of_word_suffix"), made["model"].get("dropout")) == ("BPE", END_OF_WORD, None)
        and not any(re.search("\\s", x["content"]) or not x["content"].startswith("<|") for x in made.get("added_tokens", []))
    )


class Encoder:
    """Ids of many texts at once.

    Under a tokenizer that works on parts of white-space words, the texts are cut into such parts by array operations, and each
    distinct part is encoded once and kept; ids of occurrences are taken from the kept ones. A word that holds a character
    which is not plain, or the start of a special token, is one part in its own spelling. Under any other tokenizer, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_parts = Tokenizer.from_file(path), _by_parts(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        if self.by_parts:
            # plain parts are in lower case and composed, and come one to a word: the other steps would leave them as they are
            from tokenizers import pre_tokenizers

            self.of_plain = Tokenizer.from_file(path)
            self.of_plain.normalizer = None
            self.of_plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Keep the ids of parts that are not known; plain ones are encoded in a row and told apart by the mark that ends a part."""
        body = " ".join(parts)
        plain, odd = (parts, []) if not _ODD.search(body) else ([x for x in parts if not _ODD.search(x)], [x for x in parts if _ODD.search(x)])
        ids = np.array(self.of_plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) == len(plain):
            size = np.diff(stop, prepend=0)
        else:
            ids, size = self._whole(plain)
        more, more_size = self._whole(odd)
        size = np.concatenate([size, more_size])
        self.known.update(zip(plain + odd, range(len(self.size), len(self.size) + len(size))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids, more]), np.concatenate([self.size, size])

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds, low = _plain()
        cps, at = codepoints(texts)
        kind = kinds[cps]
        solid = kind != 0
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        odd = kind == 4
        odd[:-1] |= (cps[:-1] == 60) & (cps[1:] == 124)
        change = kind[1:] != kind[:-1]
        change |= kind[1:] == 2
        if odd.any():
            begin = np.flatnonzero(first)
            spoilt = np.logical_or.reduceat(odd, begin)
            odd = np.repeat(spoilt, np.diff(np.append(begin, len(cps)))) if len(begin) else odd[:0]
            odd = np.concatenate([np.zeros(len(cps) - len(odd), bool), odd])
            change &= ~odd[1:]
            cps = np.where(odd, cps, low[cps])
        else:
            cps = low[cps]
        first[1:] |= change & solid[1:]
        begin = np.flatnonzero(first)
        owner = np.searchsorted(begin, at)
        width = solid.astype(np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += cps >= least
        ends = np.cumsum(width, dtype=np.int64)
        bounds = np.append(ends[begin] - width[begin], ends[-1:])
        raw = cps[solid].tobytes().decode("utf-32-le").encode()
        parts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [x for x in distinct if x not in self.known]:
            self._learn(new)
        row = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))[parts.indices.to_numpy()]
        size = self.size[row]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[row] - upto[:-1], size) + np.arange(upto[-1])]
        if len(self.known) > CACHED_PARTS or len(self.ids) > CACHED_PARTS * CACHED_CHARS:
            self._forget()
        return ids, np.diff(upto[owner])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each. A long text is encoded in runs cut at white space."""
        if not self.by_parts:
            return self._whole(texts)
        if sum(map(len, texts)) <= RUN_CHARS:
            return self._run(texts)
        ids, sizes = [], []
        for text in texts:
            at, n = 0, 0
            while at < len(text) or not at:
                gap = _GAP.search(text, at + RUN_CHARS) if len(text) - at > RUN_CHARS else None
                to = gap.start() if gap else max(1, len(text))
                got, _ = self._run([text[at:to]])
                ids.append(got)
                at, n = to, n + len(got)
            sizes.append(n)
        return np.concatenate(ids), np.array(sizes, np.int64)


def cuts(n: int, capacity: int, fine: bool) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    floor = FINE_FLOOR if fine else max(FINE_FLOOR, capacity // COARSE_PARTS)
    while rest > floor:
        out.append(rest - rest // 2)
        rest //= 2
    return out + [rest] if rest else out


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(id_col, start, length, doc_tokens, ids, spot): the pieces of each document with their little-endian ids."""

    def rows(batches):
        encode, spot, filled = Encoder(tokenizer), TaskContext.get().partitionId() << 34, capacity - 1
        for batch in batches:
            for part in slices(batch, "text", RUN_CHARS):
                ids, sizes = encode([t or "" for t in part.column("text").to_pylist()])
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), sizes + 1
                upto = filled + np.cumsum(sizes % capacity)
                fine = np.diff(upto // capacity, prepend=filled // capacity) > 0
                filled = int(upto[-1])
                lengths = [cuts(n, capacity, f) for n, f in zip(sizes.tolist(), fine.tolist())]
                many = np.array([len(x) for x in lengths])
                length = np.concatenate([np.array(x, np.int64) for x in lengths])
                end = np.cumsum(length)
                start = end - length - np.repeat(np.cumsum(sizes) - sizes, many)
                owner = pa.array(np.repeat(np.arange(len(many)), many))
                held = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, 4 * end).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(owner), pa.array(start), pa.array(length), pa.array(np.repeat(sizes, many)), held.cast(pa.binary()), pa.array(spot + np.arange(len(length)))],
                    ["id", "start", "length", "doc_tokens", "ids", "spot"],
                )
                spot += len(length)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(lean(rows), f"id {kind}, start long, length long, doc_tokens long, ids binary, spot long").withColumnRenamed("id", id_col)


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of docs in its sequence."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    pieces = written(pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "spot"), "pieces")
    n_pieces, n_ids = pieces.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("length") < capacity, F.col("length"))), F.lit(0))).first()
    return pack(pieces, n_pieces, capacity, n_ids)


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, of k, of each size under multiway differencing."""
    n = len(sizes)
    left, right = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    made = n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    if k == 1:
        return np.zeros(n, np.int64)
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - k
        b, y = b[::-1], y[::-1]
        if both <= 0:
            v, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            cut = len(a) - both
            fresh = np.arange(made, made + both)
            left[fresh], right[fresh] = x[cut:], y[:both]
            made += both
            v, nodes = np.concatenate([a[:cut], a[cut:] + b[:both], b[both:]]), np.concatenate([x[:cut], fresh, y[both:]])
        order = np.argsort(-v, kind="stable")
        v, nodes = v[order], nodes[order]
        if len(v) == k:
            v = v - v[-1]
        heapq.heappush(heap, (-int(v[0]), serial, v, nodes))
        serial += 1
    part = np.full(2 * n, -1, np.int64)
    part[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(made - 1, n - 1, -1):
        part[left[node]] = part[right[node]] = part[node]
    return part[:n]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; whole pieces first, one each."""
    out = np.empty(len(sizes), np.int64)
    whole = sizes == capacity
    out[whole] = np.arange(whole.sum())
    rest = sizes[~whole]
    if len(rest):
        k, step = int(-(-rest.sum() // capacity)), 1
        full, part = k - 1, None
        while part is None or k - full > 1:
            trial = k if part is None else (k + full) // 2
            found = differenced(rest, trial)
            if np.bincount(found, rest).max() <= capacity:
                k, part = trial, found
            elif part is None:
                full, k, step = k, k + step, step * 2
            else:
                full = trial
        out[~whole] = whole.sum() + part
    return out


def pack(pieces: DataFrame, n_pieces: int, capacity: int = 4096, n_ids: int | None = None) -> DataFrame:
    """pieces (with length and spot) with sequence_id and offset; their number, and that of the ids in those under the capacity, set the number of batches."""
    batches = -(-n_pieces // PIECES_A_BATCH)
    if n_ids is not None:
        batches = max(min(batches, n_ids // (WINDOWS_A_BATCH * capacity)), -(-n_pieces // MOST_PIECES))
    batches = max(1, batches)

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("spot")
        sizes = rows["length"].to_numpy()
        window = windows_of(sizes, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], np.diff(window[order]) > 0]) if len(order) else np.zeros(0, bool)
        begin = ends - sizes[order]
        offset = np.empty(len(order), np.int64)
        offset[order] = begin - np.repeat(begin[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        sequence = (rows["batch"][0].as_py() << 24) + window
        return rows.drop_columns(["batch", "spot"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kept = [f for f in pieces.schema.fields if f.name != "spot"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long, offset long"])
    dealt = pieces.withColumn("batch", F.pmod(F.xxhash64("spot"), F.lit(batches)).cast("long"))
    return dealt.groupBy("batch").applyInArrow(packed, schema)
