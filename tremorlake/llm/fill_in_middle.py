"""Fill-in-the-middle transformation of whole texts, cut at code points.

A batch of texts is one run of bytes with a sparse index of its exceptions: the place of each multibyte character, in
bytes and in code points, and the bytes that all up to it have in excess of one each. A cut given in code points is
looked up among the exceptions by searchsorted and becomes a byte by adding their excess; spans of ASCII have no entry
and are plain arithmetic. Pieces are then slices of the batch's bytes.

The cuts of a document, its form and whether it is transformed at all come from a hash of seed and id, so any task
that runs again gives the same rows. Nothing is shuffled.

Defined results: a null text is the empty text, and an empty text stays plain; a text that contains a sentinel stays
plain; null ids hash as the seed alone; repeated rows each return a row, with the same cuts if their texts are equal; texts of any
length are cut whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textkit import as_bytes, slices

BATCH_BYTES = 4 << 20


class Exceptions:
    """Sparse index of the multibyte characters among the bytes of a batch of texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        size = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
        self.excess = np.concatenate([[0], np.cumsum(size)])  # bytes beyond one a character, of all before
        self.point = lead - self.excess[:-1]  # where they are, in code points of the batch
        first = np.searchsorted(lead, bounds)
        self.at = bounds - self.excess[first]  # where texts begin, in code points
        self.n = np.diff(self.at)

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte offsets of code points of the batch."""
        return points + self.excess[np.searchsorted(self.point, points)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be told apart wherever they stand: none begins inside another or inside itself."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and b in a) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    percent: int = 90,
    spm_percent: int = 20,
    seed: int = 1,
) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output): the transformed text of each row.

    n counts code points. Of the texts that can be transformed, percent are; of those spm_percent have the suffix first (spm), the
    others the prefix (psm); the rest are plain: their output is the text, and their cuts are null.
    """
    check_sentinels(sentinels)
    prefix, suffix, middle = (s.encode() for s in sentinels)

    def transformed(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                data, bounds = as_bytes(part.column("text"))
                index = Exceptions(data, bounds)
                keys = part.column("id").to_pylist()
                digests = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
                h = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)
                one, two = h[:, 0] % (index.n + 1), h[:, 1] % (index.n + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                cut, upto = index.to_bytes(index.at[:-1] + low).tolist(), index.to_bytes(index.at[:-1] + high).tolist()
                raw, off = data.tobytes(), bounds.tolist()
                whole = memoryview(raw)
                plain = (index.n == 0) | (h[:, 2] % 100 >= percent)
                for s in (prefix, suffix, middle):
                    at = raw.find(s)
                    while at >= 0:  # one search for all texts; on to the next text after a hit
                        row = int(np.searchsorted(bounds, at, "right")) - 1
                        plain[row] |= at + len(s) <= off[row + 1]
                        at = raw.find(s, max(at + 1, off[row + 1] if plain[row] else 0))
                forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_percent, "spm", "psm"))
                out, size = [], np.diff(bounds) + np.where(plain, 0, len(prefix) + len(suffix) + len(middle))
                for a, b, c, d, form in zip(off, cut, upto, off[1:], forms.tolist()):
                    if form == "plain":
                        out.append(whole[a:d])
                    elif form == "psm":
                        out += [prefix, whole[a:b], suffix, whole[c:d], middle, whole[b:c]]
                    else:
                        out += [suffix, whole[c:d], prefix, whole[a:b], middle, whole[b:c]]
                ends = np.concatenate([[0], np.cumsum(size)])
                texts = pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(out))]).cast(pa.string())
                columns = [part.column("id"), pa.array(index.n), pa.array(forms, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), texts]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(transformed, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of, from output and form alone."""
    prefix, suffix, middle = sentinels

    def parts(begin: str, between: str) -> tuple[Column, Column]:
        """What stands between the first two sentinels, and between the second and the third."""
        first = F.substring_index(output, between, 1)
        rest = F.substring(output, F.length(first) + len(between) + 1, F.length(output))
        return F.substring(first, F.lit(len(begin) + 1), F.length(first)), F.substring_index(rest, middle, 1)

    last = F.substring_index(output, middle, -1)
    (p, s), (s_, p_) = parts(prefix, suffix), parts(suffix, prefix)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p, last, s)).otherwise(F.concat(p_, last, s_))
