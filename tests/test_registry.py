"""The model registry under failures and retries; rank statistics by force."""

import datetime as dt
import itertools
import random
import tempfile

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tremorlake.operators import models, ranking
from tremorlake.sources import registry

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)


def frames(spark, n=60, shift=0.0):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], i // 5, i % 2 * 3 + rng.random() + shift, None if i == 7 else rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "i long, label string, sample_id long, x double, y double")


def request(name="m", binding=""):
    return {"domain": "vibration", "kind": "model", "binding": binding, "name": name, "algo": "forest", "origin": "trained", "data_origin": "field"}


def fit(rows):
    return models.train_fault_classifier(rows, ["x", "y"], trees=5)


class Broken:
    """A model whose save fails after a part of it is written."""

    def __init__(self, inner):
        self.inner = inner

    def write(self):
        return self

    def overwrite(self):
        return self

    def save(self, path):
        self.inner.write().overwrite().save(path + "/part")
        raise OSError("disk full")


def test_a_failed_write_leaves_the_old_model_active(spark):
    root = tempfile.mkdtemp(prefix="spark-registry-", dir="/tmp") + "/r"
    assert registry.load_active(spark, root, "vibration", "model", "m1") is None
    old = registry.train_and_store(spark, root, frames(spark), request("old"), fit)
    assert registry.active_for(spark, root, "vibration", "model", "m1") is None  # stored is not active
    assert registry.activate(spark, root, old) and not registry.activate(spark, root, old)
    whole = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(frames(spark))
    with pytest.raises(OSError):
        registry.store(spark, root, Broken(whole), request("new"), "f", {})
    assert [r.id for r in registry.models(spark, root).collect()] == [old] and registry.active_for(spark, root, "vibration", "model", "m1").id == old
    with pytest.raises(ValueError):
        registry.activate(spark, root, registry.model_id(request("new"), "f"))
    new = registry.store(spark, root, whole, request("new"), "f", {})  # the retry writes over what was left
    assert registry.activate(spark, root, new) and registry.active_for(spark, root, "vibration", "model", "m1").id == new
    assert {r.name: r.active for r in registry.registered(spark, root).collect()} == {"old": False, "new": True}
    assert registry.load_active(spark, root, "vibration", "model", "m1").stages[0].getOutputCol() == "v"


def test_storing_again_adds_nothing(spark):
    root = tempfile.mkdtemp(prefix="spark-registry-", dir="/tmp") + "/r"
    first = registry.train_and_store(spark, root, frames(spark), request(), fit)
    assert registry.train_and_store(spark, root, frames(spark).orderBy(F.desc("i")), request(), fit) == first
    other = registry.train_and_store(spark, root, frames(spark, shift=0.5), request(), fit)
    rows = {r.id: r for r in registry.models(spark, root).collect()}
    assert set(rows) == {first, other} and first != other
    r = rows[first]
    assert (r.frame_count, r.sample_count, r.feature_count, r.skipped_count, r.label_counts) == (60, 12, 2, 1, '{"a": 30, "b": 30}')
    assert r.accuracy > 0.9 and len(r.sha256) == 64 and r.size > 1000 and r.files > 3
    with pytest.raises(ValueError):
        registry.store(spark, root, None, request("") | {"origin": " "}, "f", {})


def test_a_binding_has_its_own_model_first(spark):
    root = tempfile.mkdtemp(prefix="spark-registry-", dir="/tmp") + "/r"
    whole = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(frames(spark))
    general, own = registry.store(spark, root, whole, request(), "f", {}), registry.store(spark, root, whole, request(binding="m1"), "f", {})
    registry.activate(spark, root, general)
    registry.activate(spark, root, own)
    assert [registry.active_for(spark, root, "vibration", "model", b).id for b in ("m1", "m2")] == [own, general]


def test_positions_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.randrange(50), i) for i in range(500)]
    got = ranking.numbered(spark.createDataFrame(rows, "k string, v long, i long"), ["k"], ["v", "i"], a_range=60).collect()
    assert [(r.k, r.v, r.i) for r in sorted(got, key=lambda r: (r.k, r.position))] == sorted(rows) and sorted(r.position for r in got if r.k == "b") == list(range(sum(k == "b" for k, _, _ in rows)))


def test_concordance_by_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "A_RANGE", 40)
    rng = random.Random(2)
    rows = [(k, T0 + dt.timedelta(seconds=rng.randrange(400) * 600), i, rng.choice([None, float("nan"), *[float(rng.randrange(-9, 10))] * 8]) if k < 3 else 7.0) for k in range(4) for i in range(120)] + [(9, T0, 0, 1.0)]
    df = spark.createDataFrame(rows, "k long, t timestamp, seq long, value double")
    got = {r.k: r for r in ranking.concordance(df, ["k"], "value", 20_000).collect()}
    for k in (0, 1, 2, 3, 9):
        own = [(t, s, v) for key, t, s, v in rows if key == k and v is not None and v == v]
        pairs = [((a[:2] < b[:2]) == (a[2] < b[2])) if a[2] != b[2] else None for a, b in itertools.combinations(own, 2)]
        c, d, t = pairs.count(True), pairs.count(False), pairs.count(None)
        assert (got[k].n, got[k].concordant, got[k].discordant, got[k].tied) == (len(own), c, d, t)
        assert got[k].tau is None if not c + d else abs(got[k].tau - (c - d) / (len(pairs) * (c + d)) ** 0.5) < 1e-12
    assert ranking.concordance(df.limit(0), ["k"], "value").count() == 0
