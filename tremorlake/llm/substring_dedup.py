"""Removal of word sequences that occur more than once, by difference-cover anchors.

Two equal runs of `window` words may begin at any offsets of their texts. With a difference cover of
the residues modulo a period there is always a shift under the period at which both runs stand on a
covered position, so hashing shorter windows at covered positions only is enough to meet every such
pair: five residues modulo 21, of windows of 15 words, for runs of 35. Anchors that occur once end
there; around the others the full windows are hashed and asked about in turn, and every word that a
repeated window covers is removed. Totals come from all documents; nothing is paired.

Defined results: a null text has no words; repeated rows are texts of their own, so all their windows
repeat, and they spread over chunks like other rows; a text shorter than the window keeps every word; an empty table gives an empty result; input
columns other than the id, the text and those in keep are ignored, whatever their names.
Two different windows of equal 64-bit hash would be taken for repeats (below one in 10**4 for 3 * 10**7 windows).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .textkit import Words, give_back

#: Perfect difference sets, period -> residues.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 3: (0, 1), 1: (0,)}
CHUNK_BYTES = 1 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of 40 % of the window at least."""
    period = max(p for p in COVERS if window - p + 1 >= 0.4 * window)
    return period, COVERS[period]


class _Scan:
    """One chunk's words, anchors and windows."""

    def __init__(self, rows: pa.Table, window: int):
        self.window = window
        period, cover = cover_for(window)
        self.period, width = period, window - period + 1
        self.words = Words(rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0))
        off, n = self.words.off, len(self.words.hash)
        sizes = np.diff(off)
        local = np.arange(n) - np.repeat(off[:-1], sizes)
        left = np.repeat(sizes, sizes) - local
        on = np.isin(np.arange(period), cover)[local % period]
        self.anchor_at = np.flatnonzero(on & (left >= width) & (np.repeat(sizes, sizes) >= window))
        self.anchors = self.words.windows(width)[self.anchor_at] if len(self.anchor_at) else np.zeros(0, np.uint64)
        self.window_at = np.flatnonzero(left >= window)
        self.windows = self.words.windows(window)[self.window_at] if len(self.window_at) else np.zeros(0, np.uint64)

    def extended(self, live: np.ndarray) -> np.ndarray:
        """The full windows that hold a live anchor."""
        count = np.zeros(len(self.words.hash) + 1, np.int64)
        count[self.anchor_at + 1] = blocks.found(self.anchors, live)
        count = np.cumsum(count)
        return self.windows[count[self.window_at + self.period] > count[self.window_at]]

    def removed(self, live: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.words.hash) + 1, np.int64)
        at = self.window_at[blocks.found(self.windows, live)]
        edge[at] += 1
        np.subtract.at(edge, at + self.window, 1)
        return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep: tuple = (), stored: bool = False) -> DataFrame:
    """(id_col, *keep, n_words, n_removed, kept): kept joins the words that stay by one space.

    stored: docs is a plain read of stored files; other input is written first, as its rows are read three times.
    """
    rows, size = blocks.chunked(docs, id_col, text_col, CHUNK_BYTES, keep, stored)
    buckets = max(1, size // 6 // 4 // blocks.KEYS_A_BUCKET)

    def listed(made: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(made, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("held", pa.binary())]))

    def anchors(part: pa.Table) -> pa.Table:
        return listed(blocks.asked(part["chunk"][0].as_py(), _Scan(part, window).anchors, buckets))

    def windows(part: pa.Table, reply: pa.Table) -> pa.Table:
        if not part.num_rows:
            return listed([])
        return listed(blocks.asked(part["chunk"][0].as_py(), _Scan(part, window).extended(blocks.answer(reply)[0]), buckets))

    kept_names = [f"keep_{c}" for c in keep]

    def removal(part: pa.Table, reply: pa.Table) -> pa.Table:
        scan = _Scan(part, window)
        gone = scan.removed(blocks.answer(reply)[0])
        off = scan.words.off.tolist()
        out = []
        for i, text in enumerate(part["text"].cast(pa.large_binary()).to_pylist()):
            words = (text or b"").split()
            drop = gone[off[i] : off[i + 1]]
            out.append(b" ".join(compress(words, (~drop).tolist())) if drop.any() else b" ".join(words))
        cut = np.concatenate([[0], np.cumsum(gone)])[scan.words.off]
        del scan, gone
        give_back()
        made = [part["id"], *(part[c] for c in kept_names), pa.array(np.diff(off), pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(out, pa.binary()).cast(pa.string(), safe=False)]
        return pa.table(made, names=["id", *kept_names, "n_words", "n_removed", "kept"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"id {kinds['id']}", *(f"{c} {kinds[c]}" for c in kept_names), "n_words long, n_removed long, kept string"])
    live = blocks.replies(rows.groupBy("chunk").applyInArrow(anchors, blocks.ASK), 2)
    live = blocks.replies(rows.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(windows, blocks.ASK), 2)
    out = rows.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(removal, schema)
    return out.toDF(id_col, *keep, "n_words", "n_removed", "kept")
