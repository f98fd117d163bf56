"""Quality of texts by a linear-chain conditional random field over their lines.

Every line is good or bad. A line's features are shares of kinds of characters, lengths and repeats, of
itself and of the lines before and after it; forward-backward marginals give each line's probability of
being good, their mean weighted by line length is the text's, and a logistic curve fitted to
the labels turns it into the score.

It is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows of SAMPLE_SIZE together, whole texts, chosen by a hash of
the id; a text's size is its bytes and LINE_SIZE for each line. Labels are known of texts, not of lines: the lines of a text begin
with its label, and in ROUNDS of fitting each takes the label that the field finds likelier, but for the share LEAST of its text's
length that speaks most for the text's own label. So a text may hold lines of both kinds, and the field learns switches. Every text is
scored whole; long ones are passed over in blocks at once, with the blocks' transfer matrices in between.

Defined results: a null or empty text is one empty line; rows with null labels or ids are not learned
from, nor texts over a sixteenth of SAMPLE_SIZE; repeated rows get equal scores and count once in the sample; ties of the hash go by
label and text; without both labels in the sample every score is the share of label 1;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import codepoints, slices
from .toxicity import labelled_sample, split_of

SAMPLE_ROWS = 6000
SAMPLE_SIZE, LINE_SIZE = 40 << 20, 100
#: Steps of the first round of fitting and of each later one; the share of a text's length that keeps its label.
STEPS, LATER_STEPS, ROUNDS, LEAST = 100, 25, 3, 0.25
#: Lines from which on a text is passed over in blocks.
LONG = 2048
#: Kinds of characters; the rest are letters without case.
UPPER, LOWER, OTHER, DIGIT, BLANK, STOP, SYMBOL = range(7)


@cache
def _kinds() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            kind[cp] = UPPER if c.isupper() else LOWER if c.islower() else OTHER
        else:
            kind[cp] = DIGIT if c.isdigit() else BLANK if c.isspace() else STOP if c in ".,;:'\"-?!()" else SYMBOL
    return kind


class Lines:
    """The lines of texts: off, each text's first line; size, characters; x, features with those of both neighbours."""

    def __init__(self, texts: list[str]):
        cps, at = codepoints(texts)
        end = np.flatnonzero(cps == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        self.off = np.searchsorted(start, at)
        self.size = end - start
        kind = _kinds()[cps]
        n = end + 1 - start
        share = [np.add.reduceat((kind == k).astype(np.int32), start) if len(start) else start for k in range(7)]
        share[BLANK] = share[BLANK] - 1  # the line's own end
        letters = share[UPPER] + share[LOWER] + share[OTHER]
        solid = np.maximum(1, self.size - share[BLANK])
        word = (kind != BLANK).astype(np.int8)
        begins = word.copy()
        begins[1:] &= 1 - word[:-1]
        words = np.add.reduceat(begins.astype(np.int32), start) if len(start) else start
        bang = np.add.reduceat((cps == 33).astype(np.int32), start) if len(start) else start
        with np.errstate(over="ignore"):
            weight = (cps.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
            weight ^= weight >> np.uint64(29)
            body = np.add.reduceat(weight * (np.arange(len(cps), dtype=np.uint64) - np.repeat(start, n).astype(np.uint64) + np.uint64(1)), start) if len(start) else start.astype(np.uint64)
            at_word = np.flatnonzero(begins)
            before_any = at_word[0] if len(at_word) else len(cps)
            nth = np.arange(len(cps)) - np.concatenate([np.zeros(before_any, np.int64), np.repeat(at_word, np.diff(np.append(at_word, len(cps))))]) + 1
            word_key = np.add.reduceat(weight * nth.astype(np.uint64) * word.astype(np.uint64), at_word) if len(at_word) else at_word.astype(np.uint64)
        of_line = np.searchsorted(start, at_word, "right") - 1
        again = np.flatnonzero((word_key[1:] == word_key[:-1]) & (of_line[1:] == of_line[:-1])) + 1
        repeated = np.bincount(of_line[again], minlength=len(start))
        text = np.repeat(np.arange(len(texts)), np.diff(self.off))
        key = body ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        x = np.column_stack(
            [
                np.log1p(self.size),
                share[UPPER] / np.maximum(1, letters),
                share[OTHER] / solid,
                share[DIGIT] / solid,
                share[STOP] / solid,
                share[SYMBOL] / solid,
                share[BLANK] / np.maximum(1, self.size),
                letters / solid,
                bang / solid,
                np.log1p(words),
                solid / np.maximum(1, words),
                np.isin(cps[np.maximum(end - 1, start)], [ord(c) for c in ".!?:\""]),
                kind[start] == UPPER,
                np.log(count[inverse]),
                repeated / np.maximum(1, words),
                self.size == 0,
            ]
        ).astype(np.float32) if len(start) else np.zeros((0, 16), np.float32)
        self.own = x

    @property
    def x(self) -> np.ndarray:
        return with_neighbours(self.own, self.off)


def with_neighbours(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it in its text, and whether it is the first or last one."""
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[off[:-1]], last[off[1:] - 1] = True, True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = x[first], x[last]
    return np.hstack([x, before, after, np.column_stack([first, last]).astype(np.float32)])


class _Pass:
    """Log odds of state 1 at every place of many chains, given the places up to it. Long chains are cut into blocks."""

    def __init__(self, off: np.ndarray):
        size = np.diff(off)
        step = np.where(size > LONG, np.ceil(np.sqrt(size)), np.maximum(size, 1)).astype(np.int64)
        many = -(-size // step)
        chain = np.repeat(np.arange(len(size)), many)
        head = np.cumsum(many) - many
        begin = off[chain] + (np.arange(len(chain)) - head[chain]) * step[chain]
        self.begin, self.size = begin, np.minimum(step[chain], off[chain + 1] - begin)
        self.order = np.argsort(-self.size, kind="stable")
        self.long = [(int(head[c]), int(many[c])) for c in np.flatnonzero(many > 1)]
        longest = int(self.size.max()) if len(self.size) else 0
        self.active = np.searchsorted(-self.size[self.order], -np.arange(longest), "left")

    def _entries(self, e: np.ndarray, t: np.ndarray, a: int, n: int) -> np.ndarray:
        """Log odds just before each of the n blocks from a on, by products of the blocks' transfer matrices."""
        begin, out = self.begin[a : a + n - 1], np.full(n, np.nan)
        product, move = np.tile(np.eye(2), (n - 1, 1, 1)), np.exp(t - t.max()).T
        for k in range(int(self.size[a])):
            one = e[begin + k]
            tilt = np.exp(np.column_stack([-np.maximum(one, 0), np.minimum(one, 0)]))
            now = tilt[:, :, None] * move
            if not k:
                now[0] = np.diag(tilt[0])
            product = now @ product
            product /= product.max((1, 2), keepdims=True)
        v = np.ones(2)
        for i in range(n - 1):
            v = product[i] @ v
            v = np.maximum(v / v.sum(), 1e-300)
            out[i + 1] = np.log(v[1] / v[0])
        return out

    def odds(self, e: np.ndarray, t: np.ndarray) -> np.ndarray:
        out, entry = np.empty(len(e)), np.full(len(self.begin), np.nan)
        for a, n in self.long:
            entry[a : a + n] = self._entries(e, t, a, n)
        begin, now = self.begin[self.order], entry[self.order]
        for k, m in enumerate(self.active):
            none = np.isnan(now[:m])  # the beginnings of chains
            p = np.where(none, 0, now[:m])
            moved = np.where(none, 0, np.logaddexp(t[0, 1], p + t[1, 1]) - np.logaddexp(t[0, 0], p + t[1, 0]))
            now = e[begin[:m] + k] + moved
            out[begin[:m] + k] = now
        return out


class Chain:
    """Forward and backward passes over all chains at once."""

    def __init__(self, off: np.ndarray):
        self.ahead, self.back = _Pass(off), _Pass(off[-1] - off[::-1])
        inner = np.ones(int(off[-1]), bool)
        inner[off[:-1][np.diff(off) > 0]] = False
        self.inner = np.flatnonzero(inner)

    def marginals(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of state 1 of each line, e its log odds; expected transitions under t, log scores."""
        f = self.ahead.odds(e, t)
        b = self.back.odds(e[::-1], t.T)[::-1]
        at = self.inner
        pair = np.empty((2, 2, len(at)))
        pair[:] = t[:, :, None]
        pair[1] += f[at - 1]
        pair[:, 1] += b[at]
        pair = np.exp(pair - pair.max((0, 1)))
        return 1 / (1 + np.exp(-np.clip(f + b - e, -40, 40))), (pair / pair.sum((0, 1))).sum(2)


def _mean(p: np.ndarray, lines: Lines) -> np.ndarray:
    weight = lines.size + 1.0
    total = np.concatenate([[0], np.cumsum(weight * p)])[lines.off]
    return np.diff(total) / np.diff(np.concatenate([[0], np.cumsum(weight)])[lines.off])


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def relabelled(p: np.ndarray, y: np.ndarray, lines: Lines) -> np.ndarray:
    """Label of each line: the likelier under p, but that of its text for those lines of LEAST of its length that fit that label best."""
    many = np.diff(lines.off)
    text = np.repeat(np.arange(len(y)), many)
    own = y[text]
    fits = np.where(own > 0, p, 1 - p)
    order = np.lexsort((-fits, text))
    weight = (lines.size + 1.0)[order]
    upto = np.cumsum(weight) - weight
    begin = lines.off[:-1]
    total = np.add.reduceat(weight, begin) if len(begin) else begin
    kept = np.zeros(len(p), bool)
    kept[order] = upto - np.repeat(upto[begin], many) < LEAST * np.repeat(total, many)
    return np.where(kept, own, (p >= 0.5).astype(float))


def fit(sample: DataFrame) -> dict:
    """Weights from rows (text, y); features are made where the rows are, the chain is fitted on the driver."""

    def featured(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines([t or "" for t in part.column("text").to_pylist()])
                off = lines.off
                made = [lines.own[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
                sizes = [lines.size[a:b].astype(np.int64).tobytes() for a, b in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(made, pa.binary()), pa.array(sizes, pa.binary())], ["y", "x", "size"])

    rows = sample.select("text", "y").mapInArrow(featured, "y int, x binary, size binary").toPandas()
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    lines = Lines([])
    lines.size = np.concatenate([np.frombuffer(s, np.int64) for s in rows["size"]])
    lines.off = np.concatenate([[0], np.cumsum([len(s) // 8 for s in rows["size"]])])
    lines.own = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(lines.size), -1)
    x = lines.x.astype(np.float64)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - mean) / spread, -5, 5)
    target = np.repeat(y, np.diff(lines.off))
    chain, n = Chain(lines.off), len(y)
    w = np.zeros(x.shape[1] + 5)
    own = np.append(np.arange(x.shape[1]) < lines.own.shape[1], [True, False, False, False, False])
    for nth in range(ROUNDS):
        seen = np.bincount((2 * target[chain.inner - 1] + target[chain.inner]).astype(int), minlength=4).reshape(2, 2).astype(float)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, (LATER_STEPS if nth else STEPS) + 1):
            p, moved = chain.marginals(x @ w[:-5] + w[-5], w[-4:].reshape(2, 2))
            g = (own if not nth else 1) * np.concatenate([x.T @ (p - target), [(p - target).sum()], (moved - seen).ravel()]) / n + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
        e = x @ w[:-5] + w[-5]
        # the first round judges lines one by one, as neighbours and switches say little while a text's lines share its label
        p = chain.marginals(e, w[-4:].reshape(2, 2))[0] if nth else 1 / (1 + np.exp(-np.clip(e, -40, 40)))
        if nth < ROUNDS - 1:
            target = relabelled(p, y, lines)
    z, a, b = _odds(_mean(p, lines)), 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        h = q * (1 - q)
        grad = np.array([((q - y) * z).sum() + 1e-2 * (a - 1), (q - y).sum() + 1e-2 * b])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return {"w": w, "mean": mean, "spread": spread, "curve": (a, b)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(id, score, bad_lines) of rows (id, text); bad_lines counts lines more likely bad than good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines([t or "" for t in part.column("text").to_pylist()])
                if "constant" in model:
                    p, s = np.ones(len(lines.size)), np.full(part.num_rows, model["constant"])
                else:
                    w = model["w"]
                    x = np.clip((lines.x - model["mean"]) / model["spread"], -5, 5)
                    p, _ = Chain(lines.off).marginals(x @ w[:-5] + w[-5], w[-4:].reshape(2, 2))
                    a, b = model["curve"]
                    s = 1 / (1 + np.exp(-np.clip(a * _odds(_mean(p, lines)) + b, -40, 40)))
                bad = np.diff(np.concatenate([[0], np.cumsum(p < 0.5)])[lines.off])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s), pa.array(bad.astype(np.int64))], ["id", "score", "bad_lines"])

    return docs.mapInArrow(scored, f"id {docs.schema['id'].dataType.simpleString()}, score double, bad_lines long")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted, bad_lines): trained on labelled rows whose crc32(id as text) mod parts is not held."""
    out_of = F.coalesce(split_of("id", parts) == held, F.lit(False))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    model = fit(labelled_sample(docs, labels, label, out_of, id_col, text_col, SAMPLE_ROWS, SAMPLE_SIZE, F.octet_length("text") + LINE_SIZE * n_lines))
    rows = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return rows.select(F.col("id").alias(id_col), out_of.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "bad_lines")
