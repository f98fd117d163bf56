"""Vectorised word and character scans over Arrow string columns.

Words, windows of words and character n-grams are hashed to 64 bits with numpy, a few bytes of
scratch a byte of text; a batch is cut into slices of bounded size first. A text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 19
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**64 - 1, 256, dtype=U)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z in lower case and a blank for all others of ASCII that are neither letters nor digits.
PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and its inverse modulo 2**64, for j < n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            rows = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(n, b, U)
                x[0] = 1
                rows.append(np.cumprod(x, dtype=U))
        _POWERS[base] = (rows[0], rows[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x over the 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about limit bytes of text each, one row at least."""
    parts = batch.combine_chunks().to_batches() if isinstance(batch, pa.Table) else [batch]
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield part.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return the memory that this process has freed, but its allocators keep, to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, a function for mapInArrow, that gives memory back after each batch and at its end.

    Python workers live on between tasks and stages, and what they keep counts against the executor of every later stage.
    """

    def run(batches):
        def one_by_one():
            for batch in batches:
                yield batch
                give_back()

        yield from rows(one_by_one())
        give_back()

    return run


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(off):
        off = np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a column: start, end (bytes), hash, and off, each text's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, bounds = as_bytes(texts)
        blank = _BLANK[self.data]
        before, after = np.ones(len(blank), bool), np.ones(len(blank), bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = bounds[(bounds > 0) & (bounds < len(blank))]
        before[inner], after[inner - 1] = True, True
        self.start, self.end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        self.off = np.searchsorted(self.start, bounds)
        power, inverse = powers(_BASE, len(blank) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(blank) + 1, U)
            np.cumsum((_LOWER if lower else _BYTE)[self.data] * power[: len(blank)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the width words from each word on; those that leave their text are of no use."""
        n = len(self.hash)
        power, inverse = powers(_STEP, n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U)
            np.cumsum(self.hash * power[:n], out=total[1:])
            m = max(0, n - width + 1)
            return mix((total[width : width + m] - total[:m]) * inverse[:m] + U(width))

    def whole(self, a: int, b: int) -> np.uint64:
        """Hash of the words a to b as one window."""
        power, inverse = powers(_STEP, b + 1)
        with np.errstate(over="ignore"):
            return mix((self.hash[a:b] * power[a:b]).sum(dtype=U)[None] * inverse[a : a + 1] + U(b - a))[0] if b > a else U(0)


def codepoints(texts: list[str], edge: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by edge, and where each text begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    body = edge.join(texts) + edge if texts else ""
    return np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


def grams(cps: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n code points from each position on; the last n - 1 positions have none."""
    m = max(0, len(cps) - n + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ cps[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return h >> np.uint32(32 - bits)
