"""Similarity join, vector near-dedup and substring removal against brute force."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import blocks, jaccard_join
from tremorlake.llm.common import components
from tremorlake.llm.embedding_dedup import embedding_dedup
from tremorlake.llm.jaccard_join import ngram_jaccard_join
from tremorlake.llm.substring_dedup import COVERS, substring_dedup

DOC = "doc_id long, text string"


def closed(nodes, links):
    root = {x: x for x in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                moved = True
    return root


def texts_with_copies(seed=1, n=60, size=40):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(words, rng.integers(1, 2 * size))) for _ in range(n)]
    base = list(rng.choice(words, 60))
    for i in range(90):  # a dense group of near copies, larger than a small bucket
        copy = list(base)
        for _ in range(rng.integers(0, 3)):
            copy[rng.integers(0, 60)] = f"x{i}{rng.integers(9)}"
        out.append(" ".join(copy))
    passage = " ".join(rng.choice(words, 12))
    out += [f"{passage} {x}" for x in out[:20]]
    return out + out[:5] + ["", "   ", None, "one two", "ONE  two", "a b c d e"]


def jaccard_by_force(docs):
    sets = {}
    for i, t in docs:
        w = re.findall("[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closed(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("small, block", [(64, 500), (3, 7)])
def test_jaccard_components(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = list(enumerate(texts_with_copies()))
    out = ngram_jaccard_join(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == jaccard_by_force(docs)


def texts_with_added_words(seed=7, n=300):
    """Texts and each with words added behind, at similarities about 0.80 to 0.87, no word in two pairs."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = [f"p{i}w{j}" for j in range(int(rng.integers(60, 160)))]
        more = [f"p{i}m{j}" for j in range(int((len(a) - 4) * rng.uniform(0.15, 0.25)))]
        out += [" ".join(a), " ".join(a + more)]
    return out


@pytest.mark.parametrize("small", [64, 1])
def test_jaccard_finds_unequal_sizes(spark, monkeypatch, small):
    """Tokens of a prefix that no other prefix holds can be shared all the same."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    docs = list(enumerate(texts_with_added_words()))
    want = jaccard_by_force(docs)
    assert sum(want[i][1] == want[i + 1][1] for i in range(0, len(docs), 2)) > 200
    out = ngram_jaccard_join(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_jaccard_mixed_keeps_sets_that_can_link(spark):
    """Of own tokens only those ahead of the shared one bound what a set can share."""
    rows = [(9, i, 100, 3, 3 * i, 18, ahead, i) for i, ahead in ((1, 0), (2, 0), (3, 18))]
    entries = spark.createDataFrame(rows, "token long, id long, n long, pos int, met long, own long, ahead long, comp long")
    kept = jaccard_join._mixed(entries, spark.createDataFrame([], "a long, b long"), 80)
    assert sorted(r.id for r in kept.collect()) == [1, 2]


def test_jaccard_edges(spark):
    t = "a b c d e f g"
    rows = [(1, t, 7), (1, t, 7), (2, t, 7), (None, t, 7), (3, None, 7), (4, "", 7)]
    out = ngram_jaccard_join(spark.createDataFrame(rows, DOC + ", n_shingles int")).collect()
    assert sorted([(r.doc_id or 0, r.n_shingles, r.component_id) for r in out], key=str) == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (0, 3, None), (3, 0, 3), (4, 0, 4)], key=str)
    assert ngram_jaccard_join(spark.createDataFrame([], DOC)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 16))
    v[100:160] = v[0] + 0.05 * rng.standard_normal((60, 16))
    v[200:204] = v[1]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0, 2.0]), (305, []), (306, [2.0 * float(x) for x in v[2]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.vstack([v, 2 * v[2]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(300), 306]
    root = closed(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in embedding_dedup(df).collect()}
    assert len(got) == 307
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), root[i], root[i] == i) for k, i in enumerate(ids))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(300, 306))
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_forest_recall(spark, monkeypatch):
    """Several levels of splits, and leaves cut into blocks, find nine of ten links at least."""
    from tremorlake.llm import embedding_dedup as module

    monkeypatch.setattr(module, "LEAF", 40)
    monkeypatch.setattr(module, "BLOCK", 50)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((400, 32))
    v = np.repeat(centres, 3, 0) + 0.12 * rng.standard_normal((1200, 32))
    v[:120] = centres[0] + 0.02 * rng.standard_normal((120, 32))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df).collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.9 * near.sum()
    assert all(got[i] == near[i].sum() for i in range(120))


def test_covers_have_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def substring_by_force(docs, window):
    words = [((t or "").encode().split()) for _, t in docs]
    held = collections.Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if held[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [2, 8, 35])
def test_substrings(spark, window):
    rng = np.random.default_rng(window)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(rng.choice(words, rng.integers(0, 120))) for _ in range(60)]
    passage = " ".join(rng.choice(words, 45))
    docs += [f"{a} {passage}  {b}" for a, b in zip(docs[:9], docs[20:])] + docs[:4] + [None, "", " \t ", "x " * 200, "é ü " * 40]
    rows = list(enumerate(docs)) + [(3, docs[3]), (None, docs[4])]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], DOC + ", n_words int, kept string")
    got = sorted([tuple(r) for r in substring_dedup(df, window=window).collect()], key=str)
    assert got == substring_by_force(rows, window)


def test_chunks_of_equal_rows_and_nulls_are_bounded(spark):
    """Equal rows and rows of nulls spread over chunks by their bytes and by batches, and none is lost."""
    df = spark.sql("SELECT CAST(NULL AS long) AS doc_id, CAST(NULL AS string) AS text FROM range(100000) UNION ALL SELECT 7, repeat('same words ', 9) FROM range(100000)")
    rows, size = blocks.chunked(df, "doc_id", "text", 1 << 16)
    by = rows.groupBy("chunk").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).toPandas()
    assert by["n"].sum() == 200_000 and by["n"].max() <= 10_000 and by["b"].max() <= 1 << 16
    assert size == 100_000 * 99 + 200_000 * 16
    out = substring_dedup(df, window=5).groupBy("doc_id").agg(F.count("*"), F.sum("n_words"), F.sum("n_removed"), F.max("kept")).collect()
    assert {tuple(r) for r in out} == {(None, 100_000, 0, 0, ""), (7, 100_000, 1_800_000, 1_800_000, "")}


def test_chunks_come_again_the_same_from_shuffled_input(spark):
    """Input out of a shuffle is written once, so that all readings agree on what a chunk holds."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 50, F.lit("a b c d e f"), F.col("id") % 7).alias("text")).repartition(7)
    rows, _ = blocks.chunked(df, "doc_id", "text", 1 << 10)
    first, again = rows.select("id", "chunk").toPandas(), rows.select("id", "chunk").toPandas()
    assert first.equals(again) and len(rows.inputFiles()) > 0
    assert blocks.chunked(df, "doc_id", "text", 1 << 10, stored=True)[0].inputFiles() == []


def test_no_documents(spark):
    assert substring_dedup(spark.createDataFrame([], DOC)).count() == 0
