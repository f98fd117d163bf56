"""Queries whose tables have grown: plans that stay within memory, and rows where rounding, alphabets and ties decide."""

import datetime as dt
import random


import duckdb
import pandas as pd

from pyspark.sql import functions as F

from tremorlake.functions import quality
from tremorlake.operators import evaluation, history, ranking, text, vision
from tremorlake.sources import samples
from tremorlake.streaming import stateful

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_a_grid_of_buckets_is_not_broadcast(spark):
    """Its size is not known before it is made, so it is joined by sorting, and occupied buckets need none."""
    rows = [(p, at(60 * i), i, float(i % 7), 5000) for p in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "tag_id long, t timestamp, seq long, value double, status_code int")
    begin = int(T0.timestamp())
    told = history.statistics(df, df.select("tag_id"), begin, begin + 7200, 600).where("n > 0")
    assert "strategy=merge" in told._jdf.queryExecution().optimizedPlan().toString()
    own = history.occupied(df, begin, begin + 7200, 600)
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    names = ["tag_id", "bucket", "n", "low_t", "high_t"]
    assert sorted(map(tuple, own.select(names).collect())) == sorted(map(tuple, told.select(names).collect()))
    first = own.where("tag_id = 0 AND bucket = 1").first()
    assert (first.low_t.minute, first.high_t.minute) == (14, 13)


def test_words_of_patterns_end_at_letters_beyond_ascii(spark):
    """As in the SQL: a boundary lies between an ASCII letter and any other character, and case is folded by Unicode."""
    texts = ["tionè", "ation", "tions", "TION é", "ètheé the", "éthe", "thé", "maKe", "make", "maKe", "mail7", "MAİL7", "maıl7", "paſſ", "", None, "x\nthe\n", "Ünder", "ünder", "tionſ", "ſthe", "Kthe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = {"a": {"end": r"ing\b|tion\b", "the": r"\bthe\b", "inner": r"\Bhe\b"}, "b": {"make": "make", "mail": r"mail\d", "pass": "pass", "slash": r"\\b", "under": "ünder"}}
    got = sorted(map(tuple, text.tag_documents(df, patterns).collect()))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    for row in enumerate(texts):
        duck.execute("INSERT INTO d VALUES (?, ?)", row)
    want = [(i, kind, tag) for kind, ps in patterns.items() for tag, p in ps.items() for (i,) in duck.execute("SELECT doc_id FROM d WHERE regexp_matches(text, ?)", [f"(?i){p}"]).fetchall()]
    assert got == sorted(want) and (0, "a", "end") in got


def test_shares_are_of_decimal_digits(spark):
    """0.7 of 90 rows is 63, although 90 * 0.7 is less in doubles."""
    rows = [(p, at(i), i) for p, n in ((1, 90), (2, 10), (3, 1), (4, 180)) for i in range(n)]
    df = spark.createDataFrame(rows, "tag_id long, t timestamp, seq long")
    split = evaluation.time_block_split(df, ["tag_id"]).where("train").groupBy("tag_id").count()
    assert {r.tag_id: r["count"] for r in split.collect()} == {1: 63, 2: 7, 4: 126}
    n = spark.range(1, 2000).withColumn("d", quality.whole_share(F.col("id"), 0.29))
    assert n.where(F.col("d") != F.expr("id * 29 div 100")).count() == 0


def test_media_meet_times_without_pairs(spark):
    """Against a look at every medium: nested, equal, empty, negative and unknown lengths, spans over hours, repeated and unknown times."""
    rng = random.Random(3)
    media = [(rng.choice([1, 2, None]), i, at(60 * rng.randrange(300)), rng.choice([0, 0, 60, 600, 3600, 9000, -60, None])) for i in range(300)] + [(1, 999, None, 60)]
    asked = [(rng.choice([1, 2, 3, None]), at(60 * rng.randrange(480))) for _ in range(600)] + [(1, None), (1, None), (None, None)]
    got = samples.media_at(spark.createDataFrame(media, "tag_id long, media_id long, start timestamp, seconds long"), spark.createDataFrame(asked, "tag_id long, t timestamp"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

    def covers(m, tag, t):
        return m[0] == tag and None not in (tag, t, m[2]) and (m[2] == t or m[2] <= t < m[2] + dt.timedelta(seconds=m[3] or 0))

    want = {(tag, t): max(((m[2], m[1]) for m in media if covers(m, tag, t)), default=(None, None))[1] for tag, t in asked}
    found = [(r.tag, r.t and r.t.replace(tzinfo=dt.timezone.utc), r.media_id) for r in got.collect()]
    assert len(found) == len(want) and {(a, b): c for a, b, c in found} == want


def test_suppression_of_many_images_side_by_side(spark):
    """Against a loop over detections: small and crowded images, equal confidences, images over batches, more than the most that may stay."""
    rng = random.Random(8)
    rows = []
    for image, n in [*((i, rng.randrange(9)) for i in range(200)), (900, 700), (901, 400)]:
        for k in range(n):
            x, y, w = (rng.uniform(0, 40), rng.uniform(0, 40), 25.0) if image != 901 else (50.0 * k, 0.0, 20.0)
            rows.append((f"i{image}", 1000 * image + k, rng.randrange(3), round(rng.uniform(0.5, 1.0), 2), x, y, x + w, y + rng.choice([0.0, w])))
    want = []
    for image in {r[0] for r in rows}:
        left, n = sorted((r for r in rows if r[0] == image and r[3] > 0.55), key=lambda r: (-r[3], r[1])), 0
        while left and n < vision.AFTER:
            a = left.pop(0)
            want.append(a[1])
            n += 1

            def over(b):
                inter = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
                union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter
                return a[2] == b[2] and inter > 0.45 * (union if union > 0 else 1)

            left = [b for b in left if not over(b)]
    df = spark.createDataFrame(rows, "image_id string, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        assert sorted(r.det_id for r in vision.non_max_suppression(df).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_quantile_without_one_task_for_all_values(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 1.0, None, 3.0, 3.0, 9.0, 2.0, 3.0, 7.5]], "v double")
    for share in (0.0, 0.1, 0.5, 0.7, 0.93, 1.0):
        want = df.agg(F.percentile("v", share)).first()[0]
        for a_range in (1, 3, 100):
            assert abs(ranking.quantile(df, "v", share, a_range) - want) < 1e-12
    assert ranking.quantile(df.where("v IS NULL"), "v", 0.5) is None
    split = evaluation.speed_split(df, "v")
    assert "percentile" not in split._jdf.queryExecution().optimizedPlan().toString() and split.where("train").count() == 5


def test_a_key_of_a_stream_asks_for_its_state_once():
    """Each call goes to the JVM and back for every key of a batch: one read, one write, one timer; no rows, no frame."""
    calls = []

    class Kept:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        kept = Kept()

        def getValueState(self, name, schema):
            return self.kept

        def registerTimer(self, ms):
            calls.append("timer")

    class Timers:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    p, timers = stateful.LimitLevels({"HI": 8.0}, 0.5, 86400), Timers()
    p.init(Handle())
    frame = pd.DataFrame({"key": 1, "t": pd.to_datetime([3, 1, 2], unit="s"), "seq": [3, 1, 2], "value": [7.0, 9.0, None], "label": [None, None, None]})
    assert list(p.handleInputRows((1,), iter([frame]), timers)) == [] and calls == ["get", "update", "timer"]
    calls.clear()
    timers.now = 5000
    (out,) = p.handleExpiredTimer((1,), timers, None)
    assert calls == ["get", "update", "timer"]
    assert out.values.tolist() == [[1, "HI", "raised", 1_000_000, 1, 9.0], [1, "HI", "cleared", 3_000_000, 3, 7.0]]
