"""Alarms with delay and hysteresis, silence of sources, equal values dropped, over whole tables.

stateful.py has the streaming forms; both count time on the samples' own axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def state_of(value: Column, rows: list[tuple[float, float, str]], exception: str = "exception") -> Column:
    """The first row (low, high, state) whose range holds the value; exception for no number; normal where none does."""
    out = F.when(value.isNull(), exception)
    for low, high, state in rows:
        out = out.when((value >= low) & (value <= high), state)
    return out.otherwise("normal")


def state_changes(samples: DataFrame, state: Column, by: list[str]) -> DataFrame:
    """Rows where the state differs from the one before, the first of each series included."""
    w = Window.partitionBy(*by).orderBy("t", "seq")
    marked = samples.withColumn("state", state).withColumn("before", F.lag("state").over(w))
    return marked.where(F.col("before").isNull() | (F.col("before") != F.col("state")))


def debounced(samples: DataFrame, condition: Column, by: list[str], on_s: float, off_s: float, until: Column | None = None) -> DataFrame:
    """(by, kind, t, value): alarms raised after the condition held on_s, cleared after it was gone off_s.

    An event carries the time at which its run of the condition began, and that sample's value. A run lasts until the next one
    begins, the last one until its last sample, or until the time until if given.
    """
    w = Window.partitionBy(*by).orderBy("t", "seq")
    rows = samples.withColumn("on", F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(1))).over(w))
    runs = rows.groupBy(*by, "run", "on").agg(F.min("t").alias("t"), F.max("t").alias("last"), F.min_by("value", F.struct("t", "seq")).alias("value"))
    v = Window.partitionBy(*by).orderBy("run")
    held = (F.unix_micros(F.coalesce(F.lead("t").over(v), F.col("last") if until is None else F.greatest("last", until))) - F.unix_micros("t")) / 1e6
    solid = runs.withColumn("held", held).where((F.col("on") & (F.col("held") >= on_s)) | (~F.col("on") & (F.col("held") >= off_s)))
    # of solid runs in a row of one kind the first tells; a series begins cleared
    first = F.coalesce(F.lag("on").over(v), F.lit(False)) != F.col("on")
    return solid.withColumn("first", first).where("first").select(*by, F.when(F.col("on"), "raised").otherwise("cleared").alias("kind"), "t", "value")


def hysteresis(samples: DataFrame, limit: Column, dead_band: Column, by: list[str]) -> DataFrame:
    """samples with active: on at or above the limit, off at or below limit - dead_band, else as before; off at first."""
    w = Window.partitionBy(*by).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    says = F.when(F.col("value") >= limit, True).when(F.col("value") <= limit - dead_band, False)
    return samples.withColumn("active", F.coalesce(F.last(says, ignorenulls=True).over(w), F.lit(False)))


def limit_levels(samples: DataFrame, limits: dict[str, float], dead_band: float, by: list[str]) -> DataFrame:
    """samples with the levels LL, LO, HI, HH that are active, each with its own one-sided dead band."""
    out = samples
    w = Window.partitionBy(*by).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    for name, limit in limits.items():
        v, edge = (F.col("value"), limit) if name in ("HI", "HH") else (-F.col("value"), -limit)
        says = F.when(v >= edge, True).when(v <= edge - dead_band, False)
        out = out.withColumn(name, F.coalesce(F.last(says, ignorenulls=True).over(w), F.lit(False)))
    return out


def limit_events(samples: DataFrame, limits: dict[str, float], dead_band: float, by: list[str]) -> DataFrame:
    """(by, level, kind, t, seq, value) where a level of limit_levels is raised or cleared; all are clear at first."""
    w = Window.partitionBy(*by).orderBy("t", "seq")
    rows = limit_levels(samples, limits, dead_band, by)
    each = F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("active"), F.coalesce(F.lag(n).over(w), F.lit(False)).alias("before")) for n in limits])
    rows = rows.select(*by, "t", "seq", "value", F.filter(each, lambda x: x["active"] != x["before"]).alias("x")).select(*by, "t", "seq", "value", F.inline("x"))
    return rows.select(*by, "level", F.when(F.col("active"), "raised").otherwise("cleared").alias("kind"), "t", "seq", "value")


def active_levels(samples: DataFrame, limits: dict[str, float], dead_band: float, by: list[str]) -> DataFrame:
    """(by, level, active) after the last sample of each series: the state from which a stream goes on."""
    rows = limit_levels(samples, limits, dead_band, by)
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*limits), F.struct("t", "seq")).alias("x"))
    return last.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"x.{n}").alias("active")) for n in limits])))


def silent_sources(samples: DataFrame, points: DataFrame, now: Column, limit_s: float = 300.0) -> DataFrame:
    """One out-of-service row (code -1007) for each point of a source that has been silent for the limit, at its last sample."""
    last = samples.groupBy("source").agg(F.max("t").alias("last_t"))
    silent = last.where((F.unix_micros(now) - F.unix_micros("last_t")) / 1e6 >= limit_s)
    return points.join(silent, "source").select("source", "tag_id", F.col("last_t").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(-1007).alias("status_code"))


def drop_equal(samples: DataFrame, by: list[str], frozen_s: float) -> DataFrame:
    """Samples that differ from the one before, or come frozen_s or more after it; the first of each series stays."""
    w = Window.partitionBy(*by).orderBy("t", "seq")
    same = F.col("value").eqNullSafe(F.lag("value").over(w)) & (F.row_number().over(w) > 1)
    soon = (F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))) / 1e6 < frozen_s
    return samples.withColumn("keep", ~(same & F.coalesce(soon, F.lit(False)))).where("keep").drop("keep")
