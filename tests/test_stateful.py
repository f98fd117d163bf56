"""Stateful streams against their batch twins, whatever the cuts of the stream, late samples and restarts."""

import collections
import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tremorlake.streaming import alarms, stateful

T0 = dt.datetime(2026, 9, 17, 8, 0, tzinfo=dt.timezone.utc)
SAMPLE = "key long, t timestamp, seq long, value double"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def random_samples(n=400, seed=4):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), at(10 * i + rng.choice([0, 0, 3])), i, rng.choice([None, float("nan"), *[round(rng.uniform(0, 10), 1)] * 9])) for i in range(n)]
    return rows + [(1, rows[50][1], 50_000, 9.0), (1, rows[50][1], 50_001, 0.0), (None, at(5), 0, 9.0), (2, None, 0, 9.0)]


class Stream:
    """A folder of files, each a micro-batch, and queries over it that can be stopped and started again."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.at, self.n = spark, schema, tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp"), 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.at}/in/{self.n:04d}")

    def run(self, build, name="q"):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/in/*")
        out = build(source)
        q = out.writeStream.format("parquet").option("path", f"{self.at}/{name}/out").option("checkpointLocation", f"{self.at}/{name}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.schema(out.schema).parquet(f"{self.at}/{name}/out")


def cut(rows, sizes):
    out, k = [], 0
    for n in sizes:
        out.append(rows[k : k + n])
        k += n
    return [x for x in [*out, rows[k:]] if x]


def tuples(df, *names):
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("cuts", [[], [1, 100, 7, 150]])
def test_limit_levels_do_not_depend_on_cuts_or_restarts(spark, cuts):
    """Files arrive shuffled within 40 s, after every other file the query is stopped and started from its checkpoint."""
    rows = random_samples()
    limits = {"LL": 0.5, "LO": 1.5, "HI": 8.0, "HH": 9.5}
    shuffled = sorted(rows, key=lambda r: (r[1] or T0) + dt.timedelta(seconds=random.Random(str(r)).randrange(40)))
    s = Stream(spark, SAMPLE)
    for part in cut(shuffled, cuts):
        s.add(part)
        got = s.run(lambda x: stateful.limit_alarms_stream(x, limits, 0.5, delay_s=60))
    s.add([(9, at(5000), 0, 5.0)])  # event time goes on
    got = tuples(s.run(lambda x: stateful.limit_alarms_stream(x, limits, 0.5, delay_s=60)), "key", "level", "kind", "t", "seq")
    clean = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None], SAMPLE).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    assert got == tuples(alarms.limit_events(clean, limits, 0.5, ["key"]), "key", "level", "kind", "t", "seq") and len(got) > 100


def test_levels_start_from_a_batch_table(spark):
    """A stream that begins where a table ends goes on as if both were one."""
    rows = [r for r in random_samples() if r[0] is not None and r[1] is not None and not (r[3] is not None and r[3] != r[3])]
    rows.sort(key=lambda r: (r[1], r[2]))
    limits = {"LO": 2.0, "HI": 7.0}
    history, rest = spark.createDataFrame(rows[:200], SAMPLE), rows[200:]
    initial = alarms.active_levels(history, limits, 1.0, ["key"])
    s = Stream(spark, SAMPLE)
    s.add(rest)
    got = tuples(s.run(lambda x: stateful.limit_alarms_stream(x, limits, 1.0, initial=initial)), "key", "level", "kind", "t", "seq")
    every = alarms.limit_events(spark.createDataFrame(rows, SAMPLE), limits, 1.0, ["key"])
    assert got == tuples(every.where(F.col("t") >= F.lit(rest[0][1])).where(F.struct("t", "seq") >= F.struct(F.lit(rest[0][1]).alias("t"), F.lit(rest[0][2]).cast("long").alias("seq"))), "key", "level", "kind", "t", "seq")


def test_state_changes_do_not_depend_on_cuts(spark):
    rows = random_samples(seed=9)
    state = alarms.state_of(F.when(~F.isnan("value"), F.col("value")), [(8.0, 1e9, "high"), (5.0, 1e9, "raised")])
    s = Stream(spark, SAMPLE)
    for part in cut(sorted(rows, key=lambda r: r[1] or T0), [120, 3, 90]):
        s.add(part)
    got = tuples(s.run(lambda x: stateful.state_changes_stream(x, state)), "key", "before", "state", "t", "seq")
    batch = alarms.state_changes(spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None], SAMPLE), state, ["key"])
    assert got == tuples(batch, "key", "before", "state", "t", "seq")


def test_a_delay_ends_between_samples(spark):
    """The alarm comes out when event time has gone past the delay, though its key sends nothing more."""
    s = Stream(spark, SAMPLE)
    s.add([(1, at(0), 0, 0.0), (1, at(60), 1, 5.0)])
    build = lambda x: stateful.debounced_stream(x, F.col("value") >= 3, 30, 30)
    assert s.run(build).count() == 0
    s.add([(2, at(100), 0, 0.0)])
    assert [(r.key, r.kind, r.t.minute, r.value) for r in s.run(build).collect()] == [(1, "raised", 1, 5.0)]


def test_debounce_does_not_depend_on_cuts(spark):
    rows = [r for r in random_samples(seed=2) if r[0] is not None and r[1] is not None]
    s = Stream(spark, SAMPLE)
    for part in cut(sorted(rows, key=lambda r: r[1]), [50, 1, 200]):
        s.add(part)
    df = spark.createDataFrame(rows, SAMPLE).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    got = tuples(s.run(lambda x: stateful.debounced_stream(x.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), F.col("value") >= 5, 60, 90)), "key", "kind", "t", "value")
    until = max(r[1] for r in rows)
    assert got == tuples(alarms.debounced(df, F.col("value") >= 5, ["key"], 60, 90, until=F.lit(until)), "key", "kind", "t", "value") and len(got) > 10


def test_state_is_kept_cleared_and_refused(spark):
    rows = [(1, at(0), '{"n": 1}'), (1, at(1), None), (1, at(2), '{"n": 2}'), (1, at(3), "[1]"), (2, at(0), '{"n": 1}'), (2, at(1), "{}"), (3, at(2), "x" * 300_000)]
    s = Stream(spark, "key long, t timestamp, state_json string")
    for part in cut(sorted(rows, key=lambda r: r[1]), [2, 3]):
        s.add(part)
    got = s.run(stateful.carried_state).orderBy("writes").collect()
    last = {r.key: r for r in got}
    assert (last[1].state, last[1].writes, last[1].since.second) == ('{"n": 2}', 2, 0)
    assert (last[3].state, last[3].writes, last[3].since) == (None, 0, None) and any((r.key, r.state, r.writes, r.since) == (2, None, 0, None) for r in got)


def test_dead_keys_are_forgotten(spark):
    """After forget_s without a sample a key begins anew, and what it kept is gone from the state."""
    s = Stream(spark, SAMPLE)
    build = lambda x: stateful.limit_alarms_stream(x, {"HI": 5.0}, 1.0, forget_s=600)
    for part in ([(1, at(0), 0, 6.0)], [(2, at(1000), 0, 1.0)], [(1, at(1100), 0, 6.0)], [(2, at(1300), 0, 1.0)]):
        s.add(part)
        got = s.run(build)
    assert [r.t for r in got.orderBy("t").collect()] == [T0.replace(tzinfo=None), at(1100).replace(tzinfo=None)]
    state = spark.read.format("statestore").option("path", f"{s.at}/q/state").option("stateVarName", "kept").load()
    assert sorted(r.key.key for r in state.collect()) == [1, 2]


def test_silence_fires_once_and_arms_again(spark):
    """Source 1 falls silent, returns and falls silent again; source 2 speaks all the while; source 3 never does."""
    s = Stream(spark, "source long, tag_id long, t timestamp")
    points = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "source long, tag_id long")
    build = lambda x: stateful.silence_stream(x, points, 300)
    talk = lambda a, b: [(2, 20, at(i)) for i in range(a, b, 50)]
    s.add([(1, 10, at(0)), (1, 11, at(20)), *talk(0, 300)])
    assert s.run(build).count() == 0
    s.add(talk(300, 310))  # 280 s of silence
    assert s.run(build).count() == 0
    s.add(talk(350, 360))
    assert tuples(s.run(build), "tag_id", "t", "status_code") == {(10, at(20).replace(tzinfo=None), -1007): 1, (11, at(20).replace(tzinfo=None), -1007): 1}
    s.add(talk(400, 900))
    s.add([(1, 10, at(880)), *talk(900, 1300)])
    got = tuples(s.run(build), "source", "tag_id", "t")
    want = [(1, tag, at(when).replace(tzinfo=None)) for tag in (10, 11) for when in (20, 880)]
    assert got == collections.Counter(want)
    rows = spark.read.schema(s.schema).parquet(f"{s.at}/in/*")
    now = F.lit(at(1250))
    batch = alarms.silent_sources(rows, points, now, 300)
    assert tuples(batch, "source", "tag_id", "t") == collections.Counter(w for w in want if w[2] == at(880).replace(tzinfo=None))
    every = stateful.silence_stream(rows, points, 300).where(F.col("silent_from") <= now)
    assert tuples(every, "source", "tag_id", "t") == got


def test_each_image_is_told_once(spark):
    """Late, doubled, zone-less, empty and too large files, with restarts between them."""
    from tremorlake.streaming import images

    folder = tempfile.mkdtemp(prefix="spark-images-", dir="/tmp")
    bindings = spark.createDataFrame([("m1", True), ("m2", False)], "binding string, enabled boolean")
    files = Stream(spark, "name string, modified timestamp, length long, content binary")
    told = Stream(spark, "name string, binding string, captured_at string, received timestamp")

    def run():
        f = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{files.at}/in/*")
        c = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 1).parquet(f"{told.at}/in/*")
        out = images.image_events(images.scored_files(f, lambda x: x.withColumn("bright", F.length("content").cast("long")), 100), c, bindings, 600, 600, 100)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return {r.name: r for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()}, spark.read.schema(out.schema).parquet(f"{folder}/out").count()

    image = lambda name, s, n=5: (name, at(s), n, b"x" * n)
    files.add([image("a", 0), image("a", 0), image("early", 10), image("empty", 20, 0), image("big", 30, 101), image("bare", 40), image("off", 50), image("lost", 60), image("odd", 65)])
    told.add([("a", "m1", "2026-09-17T09:59:00+02:00", at(5)), ("a", "m1", "2026-09-17T09:59:00+02:00", at(6)), ("bare", "m1", "2026-09-17T08:00:00", at(41)), ("off", "m2", "2026-09-17T08:00:00Z", at(51))])
    got, n = run()
    assert n == len(got) == 3 and (got["a"].t, got["a"].bright, got["a"].reject) == (dt.datetime(2026, 9, 17, 7, 59), 5, None)
    told.add([("early", "m1", "2026-09-17T08:00:09Z", at(400)), ("empty", "m1", "2026-09-17T08:00:00Z", at(300)), ("big", "m1", "2026-09-17T08:00:00Z", at(310)), ("odd", "m9", "yesterday", at(320))])
    files.add([image("a", 3), image("later", 350)])
    got, n = run()
    assert n == len(got) == 7 and got["early"].t == dt.datetime(2026, 9, 17, 8, 0, 9)
    files.add([image("far", 5000)])
    told.add([("far", "m1", "2026-09-17T10:00:00Z", at(5000)), ("lost", "m1", "2026-09-17T08:00:00Z", at(4990))])
    got, n = run()
    why = {k: r.reject for k, r in got.items()}
    assert n == len(got) and why == {"a": None, "early": None, "far": None, "empty": "empty", "big": "too large", "bare": "capture time without zone", "off": "binding disabled", "odd": "unknown binding", "lost": "no capture event", "later": "no capture event"}
    assert all((r.t is None) == (r.bright is None) == (r.reject is not None) for r in got.values())


def test_content_is_read_of_usable_files_only(spark):
    from tremorlake.sources.samples import read_images

    folder = tempfile.mkdtemp(prefix="spark-images-", dir="/tmp")
    for name, n in (("a", 10), ("b", 0), ("c", 200), ("d", 10), ("e", 10), ("f", 10)):
        with open(f"{folder}/{name}.png", "wb") as f:
            f.write(b"x" * n)
    times = [("a", "2026-09-17T08:00:00Z"), ("b", "2026-09-17T08:00:00Z"), ("c", "2026-09-17T08:00:00Z"), ("d", "2026-09-17T08:00:00"), ("e", "2026-13-45T08:00:00Z")]
    captured = spark.createDataFrame([(f"file:{folder}/{n}.png", t) for n, t in times], "path string, captured_at string")
    out = read_images(spark, folder, captured, 100)
    got = {r.path[-5]: (r.reject, r.content and len(r.content), r.t) for r in out.collect()}
    none = lambda why: (why, None)
    assert got["a"] == (None, 10, dt.datetime(2026, 9, 17, 8)) and {k: v[:2] for k, v in got.items() if k != "a"} == {"b": none("empty"), "c": none("too large"), "d": none("capture time without zone"), "e": none("no ISO-8601 capture time"), "f": none("capture time missing")}
    assert "LessThanOrEqual(length,100)" in out._jdf.queryExecution().toString()
