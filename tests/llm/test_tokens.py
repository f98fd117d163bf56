"""Packing, token counts, language-model scores and decontamination against brute force."""

import collections
import hashlib
import math
import re
import tempfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tremorlake.llm.decontamination import benchmark_hits
from tremorlake.llm.lm_scoring import lm_scores
from tremorlake.llm import packing
from tremorlake.llm.packing import Encoder, differenced, pack, packed_documents, token_pieces, windows_of
from tremorlake.llm.token_counts import byte_encoder, document_token_counts, read_token_files, token_counts, token_files

DOC = "doc_id long, text string"
TEXTS = ["The cat, the CAT!", "", None, "don't <|endoftext|> stop", "a\x1cb", "Été ÉTÉ naïve ｆｕｌｌ １２ 中文", "x " * 9000, "It's 42% of $7", "  \n ", "éte Σας İstanbul"]


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i % 9, x, 0) for i, x in enumerate(TEXTS * 3)], DOC + ", length int")
    pieces = token_pieces(df, path).cache()
    rows = pack(pieces, 30).collect()
    want = collections.Counter()
    for i, x in enumerate(TEXTS * 3):
        want[(i % 9, tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,))] += 1
    got = collections.Counter()
    for first in [r for r in pieces.collect() if r.start == 0]:
        rest = sorted([r for r in pieces.collect() if r.spot >= first.spot and r.spot >> 34 == first.spot >> 34], key=lambda r: r.spot)
        ids, k = b"", 0
        while len(ids) < 4 * first.doc_tokens:
            ids, k = ids + rest[k].ids, k + 1
        got[(first.doc_id, tuple(np.frombuffer(ids, "<u4").tolist()))] += 1
    assert got == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(token_pieces(spark.createDataFrame([], DOC), path), 0).count() == 0


def test_encoder_agrees_with_the_tokenizer(monkeypatch):
    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encode.by_parts
    odd = ["ÀÉÎ İstanbul 12½³ ΣΑΣ’s '' 'll'd", "a b\u0085c\x1cd é e\u0301 \u0301f", "日本語 текст Ÿÿ ſt \u2003 x \u200b \ud7ff", "   ", "Kǅ 𝔘𝟘 5'6 %'s a'"]
    odd += ["<|ENDOFTEXT|> x<|startoftext|>y <| |> <a <", "٣٤ ⅷ ² it's%'re", "a\x00b \xadc"] + [x or "" for x in TEXTS]
    want = [encode.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]
    for _ in range(2):
        ids, sizes = encode(odd)
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    monkeypatch.setattr(packing, "RUN_CHARS", 50)
    monkeypatch.setattr(packing, "CACHED_PARTS", 20)
    ids, sizes = encode([*odd, "word " * 500])
    assert sizes[:-1].tolist() == [len(x) for x in want] and sizes[-1] == 500


def test_encoder_of_another_kind_encodes_whole():
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encode.by_parts
    for x in ("The cat  sat.", "", "é\n\n x"):
        assert encode([x])[0].tolist() == encode.tokenizer.encode(x, add_special_tokens=False).ids


def test_packed_documents(spark):
    """Checksums and token counts of every piece, gapless sequences and little padding, on texts of many lengths."""
    import zlib

    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "Gamma", "delta9", "été", "x"]
    docs = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 6000, 250))] + [(7, None), (7, None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packed_documents(spark.createDataFrame(docs, DOC).withColumn("offset", F.lit(1)), path).toPandas()
    tokenizer = Encoder(path).tokenizer
    for i, x in docs[:250]:
        ids = np.array([*tokenizer.encode(x, add_special_tokens=False).ids, 2], "<u4")
        mine = rows[(rows["doc_id"] == i) & (rows["doc_tokens"] == len(ids))].sort_values("start")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine["start"], mine["length"])] == mine["ids_crc32"].tolist()
        assert mine["length"].sum() == len(ids)
    assert len(rows[(rows["doc_id"] == 7) & (rows["doc_tokens"] == 1)]) >= 2
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 4096
    assert rows["length"].sum() > 0.98 * 4096 * rows["sequence_id"].nunique()


def test_differencing_levels_parts():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 500)
    part = differenced(sizes, 37)
    sums = np.bincount(part, sizes, 37)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 5
    assert differenced(np.array([8, 7, 6, 5, 4]), 2).tolist().count(0) in (2, 3)
    window = windows_of(np.array([4096, 3000, 3000, 1096, 4096]), 4096)
    assert np.bincount(window, [4096, 3000, 3000, 1096, 4096]).max() <= 4096 and len(set(window)) == 4


@pytest.mark.parametrize("low, high", [(1, 4000), (900, 1000), (1300, 1700), (2050, 2300), (3000, 3100), (2049, 2050), (1, 9000)])
def test_padding_of_many_lengths(spark, low, high):
    """Little padding whatever the lengths are, with the cuts and batches of the operator."""
    words = np.random.default_rng(low).integers(low, high, 1000)
    docs = spark.createDataFrame([(i, "the " * (int(n) - 1)) for i, n in enumerate(words)], DOC).repartition(4)
    rows = packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert rows["length"].sum() == words.sum() and rows.groupby("sequence_id")["length"].sum().max() <= 4096
    padded = 4096 * rows["sequence_id"].nunique() - rows["length"].sum()
    assert padded <= 0.005 * words.sum() + 4096


def test_padding_of_tiny_texts():
    """Batches of tiny texts grow until the share of their last window is little."""
    sizes = np.random.default_rng(3).integers(2, 20, 60_000)
    window = windows_of(sizes, 4096)
    assert np.bincount(window, sizes).max() <= 4096 and 4096 * (window.max() + 1) - sizes.sum() < 2 * 4096


def test_windows_rise_to_the_first_number_that_fits():
    """Pieces over half the capacity need a window each, and no more are opened."""
    assert len(set(windows_of(np.full(101, 2049), 4096))) == 101
    assert len(set(windows_of(np.array([2049] * 50 + [2047] * 50), 4096))) == 50


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_token_counts(spark, block):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = byte_encoder(path)
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)], DOC + ", nth int").repartition(2)
    got = {r.id: r.n_tokens for r in document_token_counts(token_files(df, path, block_tokens=block)).collect()}
    assert got == {i: len(encode(x or "")) for i, x in enumerate(TEXTS)}
    assert document_token_counts(token_files(spark.createDataFrame([], DOC), path)).count() == 0


def test_flat_files_with_an_open_end(spark):
    path = tempfile.mkdtemp(prefix="spark-flat-", dir="/tmp")
    ids = np.array([5, 6, 9, 9, 1, 2, 3, 9, 4], "<u2")
    ids.tofile(f"{path}/a.bin")
    for size in (2, 4, 64):
        rows = token_counts(read_token_files(spark, path, size), end_id=9).orderBy("nth").collect()
        assert [(r.start, r.n_tokens, r.ended) for r in rows] == [(0, 2, True), (3, 0, True), (4, 3, True), (8, 1, False)]


def lm_by_force(docs, order, alpha=0.4, least=2):
    words = [re.findall("[^ \t\n\v\f\r]+", (t or "").lower()) for _, t in docs]
    held = collections.Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for (i, _), w in zip(docs, words):
        s = 0.0
        for p in range(len(w)):
            for n in range(min(order, p + 1), 0, -1):
                g = tuple(w[p - n + 1 : p + 1])
                if n == 1:
                    s += math.log10(held[g] / total)
                elif held[g] >= least:
                    s += math.log10(held[g] / held[g[:-1]])
                    break
                else:
                    s += math.log10(alpha)
        out.append((i, len(w), s if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, order):
    rng = np.random.default_rng(order)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 40)))) for i in range(40)] + [(50, None), (51, " "), (3, "a b")]
    got = sorted([(r.doc_id, r.n_words, r.log10_score) for r in lm_scores(spark.createDataFrame(docs, DOC), order=order).collect()], key=str)
    want = sorted(lm_by_force(docs, order), key=str)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] or sorted((a, b) for a, b, _ in got) == sorted((a, b) for a, b, _ in want)
    close = lambda rows: sorted((a, b, None if c is None else round(c, 6)) for a, b, c in rows if c is not None)
    assert close(got) == close(want)
    assert lm_scores(spark.createDataFrame([], DOC)).count() == 0


def test_lm_scores_use_trigrams(spark):
    """By default a word is scored with two words of context."""
    docs = [(0, "a b c d"), (1, "a b c e"), (2, "x b c f"), (3, "x b c f")]
    got = {r.doc_id: r.log10_score for r in lm_scores(spark.createDataFrame(docs, DOC)).collect()}
    three = {i: c for i, _, c in lm_by_force(docs, 3)}
    assert all(abs(got[i] - three[i]) < 1e-6 for i in three) and three != {i: c for i, _, c in lm_by_force(docs, 2)}


def hits_by_force(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(10, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[p : p + m])].add(str(i))
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    found |= windows[tuple(w[p : p + m])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)] + ["É", "été"]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(20)] + [(20, None), (21, "..."), (3, "w1 w2"), (22, "Zebra")]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"{docs[i][1]}, {t.upper() if t and i % 2 else t}! {docs[i + 1][1]}") for i, t in items[:20]]
    docs += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (None, items[1][1]), (203, " ".join(items[2][1].split()[1:]))]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], DOC + ", n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted([tuple(r) for r in benchmark_hits(d, b).collect()], key=str) == hits_by_force(docs, items)
    assert benchmark_hits(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert benchmark_hits(d.limit(0), b).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]
