"""Classifiers on held-out rows, and the pipeline, on the driver's tables."""

import os

import numpy as np
import pytest

from tremorlake.llm.language_id import _Words, language_id, viterbi
from tremorlake.llm.quality import Chain, quality
from tremorlake.llm.toxicity import toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, toxic int, quality int"


def by_force(scores, switch):
    """The best path by trying all."""
    import itertools

    n, k = scores.shape
    return max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))


def test_viterbi_paths():
    rng = np.random.default_rng(0)
    scores = rng.standard_normal((14, 3)).astype(np.float32) * 3
    got = viterbi(scores, np.array([0, 6, 6, 14]), 2.0)
    for a, b in ((0, 6), (6, 14)):
        assert tuple(got[a:b]) == by_force(scores[a:b], 2.0)


def test_viterbi_of_long_texts_in_blocks(monkeypatch):
    from tremorlake.llm import language_id as m

    rng = np.random.default_rng(5)
    scores = (rng.standard_normal((3000, 5)) * 6).astype(np.float32)
    scores[:, 1:][rng.random((3000, 4)) < 0.1] = -np.inf
    off = np.array([0, 7, 7, 900, 2999, 3000])
    want = viterbi(scores, off, 3.0)
    monkeypatch.setattr(m, "LONG", 20)
    assert (viterbi(scores, off, 3.0) == want).all()


def test_score_falls_without_evidence_and_languages_have_no_limit(spark):
    words = ["".join(x) for x in np.random.default_rng(6).choice(list("abcdefghijklmnopqrstuvwxyz"), (130, 7))]
    rows = [(i, f"{w} {w} {w}", f"l{i:03d}") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows + [(500, "สวัสดีครับ", None), (501, "x " * 20_000 + words[3], None), (2, words[2], "l002"), (2, words[2], "l002")], DOC)
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in language_id(docs.select("doc_id", "text", "lang", F.lit(1).alias("h"))).collect()}
    learned = [i for i in range(130) if not got[i].held_out]
    assert all(got[i].lang_pred == f"l{i:03d}" for i in learned) and len(learned) > 90
    assert got[500].score < 0.02 and got[500].lang_pred.startswith("l")


def test_forward_backward_sums_over_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.standard_normal(5), rng.standard_normal((2, 2))
    p, moved = Chain(np.array([0, 5])).marginals(e, t)
    weight = {s: np.exp(sum(e[i] * x for i, x in enumerate(s)) + sum(t[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=5)}
    z = sum(weight.values())
    assert np.allclose(p, [sum(w for s, w in weight.items() if s[i]) / z for i in range(5)])
    assert np.isclose(moved[0, 1], sum(w * sum((a, b) == (0, 1) for a, b in zip(s, s[1:])) for s, w in weight.items()) / z)


def test_long_chains_are_passed_over_in_blocks(monkeypatch):
    from tremorlake.llm import quality as q

    rng = np.random.default_rng(2)
    off = np.array([0, 3, 900, 901, 4000])
    e, t = rng.standard_normal(4000) * 4, rng.standard_normal((2, 2)) * 2
    p, moved = Chain(off).marginals(e, t)
    monkeypatch.setattr(q, "LONG", 10)
    again, moved_again = Chain(off).marginals(e, t)
    assert np.allclose(p, again) and np.allclose(moved, moved_again)


def test_lines_of_half_good_texts(spark):
    """Labels of texts only: lines of either kind are told apart within a text, and switches are learned."""
    rng = np.random.default_rng(3)
    words = "the cat and other small animals walked along a quiet river while it rained".split()
    good = lambda: " ".join(rng.choice(words, rng.integers(8, 16))).capitalize() + "."
    bad = lambda: "".join(rng.choice(list("#$%&*=+01 "), rng.integers(20, 60)))
    docs, labels = [], []
    for i in range(240):
        kind = i % 3
        lines = [good() for _ in range(6)] if kind == 0 else [bad() for _ in range(6)] if kind == 1 else [good() for _ in range(5)] + [bad() for _ in range(5)]
        docs.append((i, "\n".join(lines), None))
        labels.append((i, 0, int(kind == 0)))
    docs.append((999, "\n".join(["."] * 300_000), None))
    out = quality(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).toPandas().set_index("doc_id")
    halves = out.loc[[i for i in range(240) if i % 3 == 2], "bad_lines"]
    assert (halves == 5).mean() > 0.8 and halves.between(3, 7).all()
    assert (out.loc[[i for i in range(240) if i % 3 == 0], "bad_lines"] == 0).mean() > 0.9
    assert len(out) == 241 and out.loc[999, "bad_lines"] >= 0


def test_words_are_letter_runs():
    w = _Words(["Ab, cé2d", "", "中 x"])
    assert w.off.tolist() == [0, 3, 3, 5] and w.size.tolist() == [2, 2, 1, 1, 1] and w.start.tolist() == [0, 4, 7, 0, 2]


def test_spans_of_mixed_text(spark):
    en, de = "the cat sat on the mat with the other cat and that was the end of it ", "der hund und die katze sind nicht auf der strasse und das ist gut so "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, en * 3 + de * 3, None), (101, None, None), (102, "123 !", "en"), (103, "", None), (None, en, "en")]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame([(*r, 0.5) for r in rows], DOC + ", score double")).collect()}
    assert [s.lang for s in got[100].spans] == ["en", "de"] and abs(got[100].spans[1].start - 3 * len(en)) < 12
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == [] for i in (101, 102, 103))
    assert got[None].lang_pred == "en" and got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert language_id(spark.createDataFrame([], DOC)).count() == 0


def test_spans_of_other_scripts(spark):
    """Scripts narrow the languages however short or long a run is."""
    en, zh = "the cat sat on the mat with the other cat and that was the end of it ", "我们今天去学校学习中文，明天在家里看书写字。"
    rows = [(i, (en if i % 2 else zh) * (1 + i % 3), "en" if i % 2 else "zh") for i in range(60)]
    mixed = {100: en + "学校 " + en, 101: "OK " + "我们今天去学校学习中文" * 30, 102: "the cat " + "我们今天去学校学习中文" * 30, 103: en + "和the学校and " + en}
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in mixed.items()], DOC)
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert [s.lang for s in got[100].spans] == ["en", "zh", "en"] and got[100].lang_pred == "en"
    assert (got[100].spans[1].start, got[100].spans[1].end) == (len(en), len(en) + 2)
    assert [s.lang for s in got[101].spans] == ["en", "zh"] and got[101].lang_pred == "zh" and got[101].score > 0.99
    assert [s.lang for s in got[102].spans] == ["en", "zh"] and got[102].lang_pred == "zh"
    assert [s.lang for s in got[103].spans] == ["en", "zh", "en", "zh", "en"]


def test_a_long_run_without_spaces_outweighs_two_switches():
    w = _Words(["the 我们 " + "我" * 60])
    table = np.zeros((1 << 16, 2), np.float32)
    table[:, 1] = -9
    s = w.scores(table, np.ones((32, 2), bool))
    assert s[:2].min() == -8 and s[2].min() < -24
    only = np.ones((32, 2), bool)
    only[w.script[1], 0] = False
    assert np.isneginf(w.scores(table, only)[1:, 0]).all() and not np.isneginf(w.scores(table, only)[:, 1]).any()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", None), (None, "c", None)], DOC + "").withColumnRenamed("lang", "score")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], LABEL)
    for f in (toxicity, quality):
        rows = f(docs, one).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert f(docs.limit(0), one).count() == 0 and f(docs, one.limit(0)).count() == 5


def _area(y, s):
    r = np.argsort(np.argsort(s, kind="stable")) + 1.0
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    lang = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.95
    tox = toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert _area(tox["toxic"].to_numpy(), tox["score"].to_numpy()) > 0.75
    good = quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert _area(good["quality"].to_numpy(), good["score"].to_numpy()) > 0.9


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    from tremorlake.llm.common import written

    d = DATA.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        kept = written(stage(spark, docs, d), name)
        assert kept.columns == p.COLUMNS and 0 < kept.count() <= docs.count()
        assert kept.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = kept
    out = p.run(spark, d)
    assert out.select("doc_id").distinct().count() == docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
