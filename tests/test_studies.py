"""Feature sets compared over repeated hold-outs, against plain Python, and what the null control shows."""

import collections
import hashlib
import statistics

import numpy as np
from pyspark.sql import functions as F

from tremorlake.operators import studies


def _rows(spark, n=240, drift=0.0):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        label = "abc"[i % 3]
        good = rng.normal("abc".index(label) * 2.0, 1.0)
        out.append((i, label, i // 12, [good, drift * i + rng.normal()], [rng.normal() + drift * i] * 3))
    out.append((n, "a", 0, [1.0, None], None))
    return spark.createDataFrame(out, "i long, label string, group long, good array<double>, poor array<double>")


def test_holdouts_by_plain_python(spark):
    rows = studies.task_rows(_rows(spark), {"ab": ["a", "b"], "abc": ["a", "b", "c"]})
    got = collections.defaultdict(dict)
    for r in studies.repeated_holdout(rows, [3, 4], 0.3).collect():
        assert got[(r.task, r.label, r.seed)].setdefault(r.group, r.train) == r.train
    groups = {x: sorted({r.group for r in rows.where(F.col("label") == x).collect()}) for x in "abc"}
    for (task, label, seed), own in got.items():
        order = sorted(groups[label], key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))
        k = min(len(order) - 1, max(1, int(len(order) * 0.3)))
        assert {g for g, train in own.items() if not train} == set(order[:k])
    assert len(got) == 10


def test_gaussian_scores_by_plain_python(spark):
    rows = studies.repeated_holdout(studies.task_rows(_rows(spark), {"abc": ["a", "b", "c"]}), [1, 2])
    x = studies.feature_rows(rows, {"good": F.col("good"), "poor": F.col("poor")}).select(*studies.KEYS, "label", "train", "x").cache()
    want, told = collections.Counter(), collections.defaultdict(list)
    for r in x.collect():
        told[(r.task, r.feature_set, r.seed)].append(r)
    for key, rs in told.items():
        fit = {}
        for label in "abc":
            m = np.array([r.x for r in rs if r.train and r.label == label])
            fit[label] = (m.mean(0), np.maximum(m.var(0), 1e-9), np.log(len(m) / sum(r.train for r in rs)))
        for r in rs:
            if not r.train:
                score = {k: p - 0.5 * np.sum(np.log(2 * np.pi * v) + (np.array(r.x) - m) ** 2 / v) for k, (m, v, p) in fit.items()}
                want[(*key, r.label, max(sorted(score), key=score.get))] += 1
    got = studies.gaussian_scores(x)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    table = {r.feature_set: r for r in studies.study_table(got).collect()}
    each = {s: statistics.median(sum(v for k, v in want.items() if k[1] == s and k[2] == seed and k[3] == k[4]) / sum(v for k, v in want.items() if k[1] == s and k[2] == seed) for seed in (1, 2)) for s in ("good", "poor")}
    assert all(abs(table[s].accuracy - each[s]) < 1e-12 for s in each) and table["good"].gain > 0.3 > table["poor"].gain


def test_the_null_control_shows_drift(spark):
    """Halves of one class can't be told apart without drift, and can with it."""
    gain = {}
    for drift in (0.0, 0.05):
        rows = studies.null_control(_rows(spark, drift=drift).where("label = 'a'"), [], ["i"])
        assert {(r.label, r["count"]) for r in rows.groupBy("label").count().collect()} == {("first half", 40), ("second half", 41)}
        x = studies.feature_rows(studies.repeated_holdout(rows, [1, 2, 3]), {"good": F.col("good")}).select(*studies.KEYS, "label", "train", "x")
        gain[drift] = studies.study_table(studies.gaussian_scores(x)).first().gain
    assert gain[0.05] > 0.3 > gain[0.0] + 0.1


def test_forests_over_the_same_splits(spark):
    rows = studies.repeated_holdout(studies.task_rows(_rows(spark), {"abc": ["a", "b", "c"]}), [1])
    x = studies.feature_rows(rows, {"good": F.col("good"), "poor": F.col("poor")}).select(*studies.KEYS, "label", "train", "x").cache()
    table = {r.feature_set: r for r in studies.study_table(studies.forest_scores(x, trees=10, at_once=2)).collect()}
    assert table["good"].gain > 0.3 > table["poor"].gain and table["good"].tested == x.where("feature_set = 'good' AND NOT train").count()
