"""Language of texts and of the spans within them.

A word is a run of letters of one script. The script, by ranges of code points, leaves those languages that were seen in
it, and no other can label the word; each is scored by the log probabilities of the word's character n-grams, and a Viterbi
pass over the words of a text, with a penalty for each switch, labels every word. Words of one label in
a row are a span; the language of most letters is that of the text. Its score is its share of the letters times the probability that
its own words give it among all languages, so it falls to one in the number of languages where words are no evidence, as in
a script that no language was seen in. Long texts are passed over in blocks at once, with the best scores across each block in between.

N-gram counts are learned from a bounded sample: at most SAMPLE_ROWS labelled rows of SAMPLE_BYTES together, whole texts, chosen by
a hash of the id; every language among them can be predicted, and memory grows with their number (a quarter of a MB each).

Defined results: a null text, or one without letters, is `und` with score 0 and no spans; of equally likely languages the first by
name is taken; repeated rows are equal; rows with null ids are predicted but not learned from; with nothing to learn from all
is `und`; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textkit import codepoints, grams, slices
from .toxicity import split_of

SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 64 << 20
#: Words from which on a text is passed over in blocks.
LONG = 4096
SIZES = (3, 4)
BITS = 16
#: Cost of a switch, and the most by which one word can speak against a language.
SWITCH, CLIP = 12.0, 8.0
#: Scripts without spaces, where a run can be a whole clause, and how many of their letters speak as one word.
UNSPACED, UNIT = ("Thai", "Kana", "Han"), 4
UNDETERMINED = "und"
#: A script is a language's if it has this share of its letters.
SCRIPT_SHARE = 0.02

#: First and last code points of scripts; other letters are one more script.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}

_UNSPACED = [list(SCRIPTS).index(x) + 1 for x in UNSPACED]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Script of every code point, 0 where it is no letter, and its lower case."""
    script = np.zeros(0x110000, np.uint8)
    low = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0xD800), *range(0xE000, 0x20000)]:
        c = chr(cp)
        if c.isalpha():
            script[cp] = len(SCRIPTS) + 1
            if len(l := c.lower()) == 1:
                low[cp] = ord(l)
    script[0x20000:0x40000] = len(SCRIPTS) + 1
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1][script[a : b + 1] > 0] = i
    return script, low


class _Words:
    """The letter runs of texts, cut where the script changes, with their n-grams: of each its bucket and its word."""

    def __init__(self, texts: list[str]):
        script, low = _letters()
        cps, at = codepoints([" " + t for t in texts], " ")
        kind = script[cps]
        letter = kind > 0
        body = np.where(letter, low[cps], np.uint32(32))
        change = kind[1:] != kind[:-1]
        first = letter.copy()
        first[1:] &= change
        start = np.flatnonzero(first)
        last = letter.copy()
        last[:-1] &= change
        self.size = np.flatnonzero(last) + 1 - start
        self.script = kind[start]
        self.off = np.searchsorted(start, at)
        self.start = start - 1 - np.repeat(at[:-1], np.diff(self.off))  # in its text
        word = np.cumsum(first) - 1
        bucket, owner = [], []
        for n in SIZES:
            g = grams(body, n, BITS)
            inner = letter[1 : len(g) + 1].copy()
            for j in range(2, n - 1):
                inner &= letter[j : len(g) + j] & (kind[j : len(g) + j] == kind[1 : len(g) + 1])
            p = np.flatnonzero(inner)
            bucket.append(g[p])
            owner.append(word[p + 1])
        self.bucket, self.owner = bucket, owner

    def scores(self, table: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Log score of each word by language: 0 for its best, CLIP less at most, and for each UNIT letters in a script
        without spaces; minus infinity where its script rules the language out."""
        total = np.zeros((len(self.size), table.shape[1]), np.float32)
        for bucket, owner in zip(self.bucket, self.owner):
            if len(owner):
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[begin]] += np.add.reduceat(table[bucket], begin, axis=0)
        ok = allowed[self.script]
        none = ~ok.any(1)
        total[~ok] = -np.inf
        total[none] = 0
        least = np.where(np.isin(self.script, _UNSPACED), np.maximum(1, self.size / UNIT), 1) * -CLIP
        out = np.maximum(total - total.max(1, keepdims=True), least[:, None].astype(np.float32))
        out[~ok & ~none[:, None]] = -np.inf
        return out


def _walk(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, switch: float, v: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The best labels along chains that begin with scores v before their first word, and end in last if given."""
    order = np.argsort(-size, kind="stable")
    begin, size, v = begin[order], size[order], v[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    stay, jump = np.zeros(scores.shape, bool), np.zeros(len(scores), np.uint16)
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        now = v[:m]
        arg = now.argmax(1)
        other = np.take_along_axis(now, arg[:, None], 1) - switch
        keep = now >= other
        stay[at], jump[at] = keep, arg
        v[:m] = np.where(keep, now, other) + scores[at]
    ends = v.argmax(1) if last is None else last[order]
    label = np.zeros(len(scores), np.uint16)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        now = ends[:m]
        label[at] = now
        ends[:m] = np.where(stay[at, now], now, jump[at])
    return label


def _blocks(scores: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of one long text: begin, size, the label before each (-1 for none) and the label each ends in."""
    n, k = scores.shape
    step = int(np.ceil(np.sqrt(n)))
    begin = np.arange(0, n, step)
    size = np.minimum(step, n - begin)
    best = np.full((len(begin), k, k), -np.inf)  # by block, label before it and label at its end
    best[:, np.arange(k), np.arange(k)] = 0
    for t in range(step):
        m = len(begin) if t < size[-1] else len(begin) - 1
        now = best[:m]
        best[:m] = np.maximum(now, now.max(2, keepdims=True) - switch) + scores[begin[:m] + t][:, None]
    v, back = best[0].max(0), np.zeros((len(begin), k), np.int64)
    for i in range(1, len(begin)):
        across = v[:, None] + best[i]
        back[i] = across.argmax(0)
        v = across.max(0)
    last = np.empty(len(begin), np.int64)
    last[-1] = v.argmax()
    for i in range(len(begin) - 1, 0, -1):
        last[i - 1] = back[i, last[i]]
    return begin, size, np.append(-1, last[:-1]), last


def viterbi(scores: np.ndarray, off: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word, of texts with words off[i] to off[i + 1]; ties stay or take the first label."""
    size, k = np.diff(off), scores.shape[1]
    short = size <= LONG
    label = _walk(scores, off[:-1][short], size[short], switch, np.zeros((int(short.sum()), k)))
    for a, n in zip(off[:-1][~short], size[~short]):
        own = scores[a : a + n].astype(np.float64)
        begin, sizes, before, last = _blocks(own, switch)
        v = np.full((len(begin), k), -np.inf)
        v[np.arange(len(begin)), before] = 0
        v[0] = 0
        label[a : a + n] = _walk(own, begin, sizes, switch, v, last)
    return label


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probability of n-gram buckets by language, and scripts by language, from (text, lang)."""
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    index = {x: i for i, x in enumerate(langs)}

    def counted(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lang = np.array([index.get(x, -1) for x in part.column("lang").to_pylist()])
                words = _Words([t or "" for t in part.column("text").to_pylist()])
                of = np.repeat(lang, np.diff(words.off))
                keys = [(of[o].astype(np.int64) << BITS) | b for b, o in zip(words.bucket, words.owner)]
                keys = [np.concatenate(keys)[np.concatenate([of[o] for o in words.owner]) >= 0]]
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                known = of >= 0
                letters = np.bincount(of[known] * 32 + words.script[known], words.size[known], minlength=1)
                at = np.flatnonzero(letters)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(letters[at].astype(np.int64))], ["key", "n"])

    got = sample.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    table = np.full((len(langs), 1 << BITS), 0.5)
    table.ravel()[key[key >= 0]] += n[key >= 0]
    letters = np.zeros((len(langs), 32))
    letters.ravel()[-1 - key[key < 0]] = n[key < 0]
    table = np.log(table / table.sum(1, keepdims=True))
    return langs, np.ascontiguousarray(table.T.astype(np.float32)), (letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)).T


def predict(docs: DataFrame, model: tuple, switch: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, spans) of rows (id, text); spans have start and end in characters, and lang."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def rows(batches):
        langs, table, allowed = sent.value
        names = np.array([*langs, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                scores, start, size, off = [], [], [], [np.zeros(1, np.int64)]
                for piece in slices(part, "text"):
                    words = _Words([t or "" for t in piece.column("text").to_pylist()])
                    scores.append(words.scores(table, allowed) if langs else np.zeros((len(words.size), 1), np.float32))
                    start.append(words.start)
                    size.append(words.size)
                    off.append(words.off[1:] + off[-1][-1])
                scores, start, size, off = map(np.concatenate, (scores, start, size, off))
                label = viterbi(scores, off, switch).astype(np.int64)
                n, width = part.num_rows, max(1, len(langs))
                text = np.repeat(np.arange(n), np.diff(off))
                share = np.bincount(text * width + label, size, n * width).reshape(n, width)
                total = share.sum(1)
                none = (total == 0) | (not langs)
                best = np.where(none, len(langs), share.argmax(1))
                mine = label == best[text]
                evidence, full = np.zeros((n, width)), np.flatnonzero(np.diff(off))
                if len(full):
                    evidence[full] = np.add.reduceat(np.where(mine[:, None], scores, 0), off[full], axis=0, dtype=np.float64)
                evidence = np.exp(evidence - evidence.max(1, keepdims=True))
                likely = evidence[np.arange(n), np.minimum(best, width - 1)] / evidence.sum(1)
                score = np.where(none, 0.0, share.max(1) / np.maximum(total, 1) * likely)
                new = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)) if langs else np.zeros(0, np.int64)
                upto = np.append(new[1:], len(label))[: len(new)] - 1
                cut = np.searchsorted(text[new], np.arange(n + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(start[upto] + size[upto]), pa.array(names[label[new]], pa.string())], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names[best], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), structs)], ["id", "lang_pred", "score", "spans"]
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """(id_col, held_out, lang_pred, score, spans): learned from rows whose crc32(id as text) mod parts is not held."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out_of = F.coalesce(split_of("id", parts) == held, F.lit(False))
    known = rows.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~out_of).withColumn("h", F.xxhash64("text"))
    keys = known.select("id", "lang", "h", F.octet_length("text").cast("long").alias("n")).where(F.col("n") <= SAMPLE_BYTES // 16)
    order = [F.xxhash64("id"), F.col("lang"), F.col("h")]
    keys = keys.orderBy(*order).limit(SAMPLE_ROWS).withColumn("upto", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    chosen = keys.where(F.col("upto") <= SAMPLE_BYTES).select("id", "lang", "h").distinct()
    sample = known.join(F.broadcast(chosen), ["id", "lang", "h"], "left_semi").dropDuplicates(["id", "lang", "h"])
    out = predict(rows.select("id", "text"), fit(sample.select("text", "lang")))
    return out.select(F.col("id").alias(id_col), out_of.alias("held_out"), "lang_pred", "score", "spans")
