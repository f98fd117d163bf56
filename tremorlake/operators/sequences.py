"""Analysis of sequences in time: runs, gaps, rates, splits of a life, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import whole_share


def _ordered(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def first_run(rows: DataFrame, by: list[str], order: list[str], mask: Column, n: int) -> DataFrame:
    """(by, run_start): where the first run of n rows in a row with mask true begins."""
    w = _ordered(by, order)
    marked = rows.withColumn("_m", F.coalesce(mask, F.lit(False))).withColumn("_i", F.row_number().over(w))
    island = marked.where("_m").withColumn("_g", F.col("_i") - F.row_number().over(_ordered(by, ["_i"])))
    runs = island.groupBy(*by, "_g").agg(F.count("*").alias("n"), F.min("_i").alias("i"), F.min_by(order[0], "_i").alias("run_start")).where(F.col("n") >= n)
    return runs.groupBy(*by).agg(F.min_by("run_start", "i").alias("run_start"), F.min("i").alias("run_index"))


def lead_and_persistence(rows: DataFrame, by: list[str], order: list[str], mask: Column, n: int) -> DataFrame:
    """(by, lead_share, persistence, early_share): life left at the first run of n, share still alarming from it on,
    and share alarming between a tenth and half of the life."""
    w = _ordered(by, order)
    marked = rows.withColumn("_m", F.coalesce(mask, F.lit(False))).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    start = first_run(rows, by, order, mask, n).select(*by, "run_index")
    on = F.col("_m").cast("double")
    out = marked.join(start, by, "left").groupBy(*by).agg(
        F.max((F.col("_n") - F.col("run_index") + 1) / F.col("_n")).alias("lead_share"),
        F.avg(F.when(F.col("_i") >= F.col("run_index"), on)).alias("persistence"),
        F.avg(F.when((F.col("_i") > 0.1 * F.col("_n")) & (F.col("_i") <= 0.5 * F.col("_n")), on)).alias("early_share"),
    )
    return out


def lead_minutes(leads: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """leads with minutes, from the start of the first run to the end of the series, and rho, the rank correlation of its values with time."""
    ends = rows.groupBy(*by).agg(F.max("t").alias("_end"))
    out = leads.join(ends, by, "left").withColumn("minutes", (F.unix_micros("_end") - F.unix_micros("run_start")) / 6e7).drop("_end")
    return out.join(spearman(rows, by, "value"), by, "left")


def alarm_summary(leads: DataFrame, by: list[str]) -> DataFrame:
    """Per indicator: machines, those that alarm, median lead and early share, machines of early share over 0.2, persistence; with
    lead_minutes also the median lead in minutes and the median rank correlation with time.
    """
    more = [F.median(c).alias(f"median_{c}") for c in ("minutes", "rho") if c in leads.columns]
    return leads.groupBy(*by).agg(
        F.count("*").alias("machines"),
        F.count("lead_share").alias("alarming"),
        F.median("lead_share").alias("median_lead"),
        F.median("early_share").alias("median_early"),
        F.count_if(F.col("early_share") > 0.2).alias("often_early"),
        F.avg("persistence").alias("persistence"),
        F.count_if(F.col("persistence") >= 0.8).alias("persistent"),
        *more,
    )


def gaps(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (t) with dt, seconds since the row before."""
    return rows.withColumn("dt", (F.unix_micros("t") - F.unix_micros(F.lag("t").over(_ordered(by, ["t", "seq"])))) / 1e6)


def cut_by_gap(rows: DataFrame, by: list[str], factor: float = 5.0) -> DataFrame:
    """rows with frame_no: a new frame where the interval exceeds factor times the most common one, the least on ties."""
    stepped = gaps(rows, by)
    common = stepped.where("dt IS NOT NULL").groupBy(*by, "dt").agg(F.count("*").alias("k")).groupBy(*by).agg(F.max_by("dt", F.struct("k", -F.col("dt"))).alias("usual"))
    new = F.coalesce((F.col("dt") > factor * F.col("usual")).cast("int"), F.lit(0))
    return stepped.join(common, by, "left").withColumn("frame_no", F.sum(new).over(_ordered(by, ["t", "seq"]))).drop("usual")


def infer_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rate): (n - 1) over the time from first to last."""
    span = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(span > 0, (F.count("*") - 1) / F.when(span > 0, span)).alias("rate"))


def base_interval(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, base): the interval at position n * 10 / 100 of the ordered ones, picked and not interpolated."""
    stepped = gaps(rows, by).where("dt IS NOT NULL")
    w = Window.partitionBy(*by)
    ranked = stepped.withColumn("_i", F.row_number().over(w.orderBy("dt"))).withColumn("_n", F.count("*").over(w))
    return ranked.where("_i = floor(_n * 10 / 100) + 1").select(*by, F.col("dt").alias("base"))


def dropped_samples(rows: DataFrame, by: list[str], factor: float = 1.5) -> DataFrame:
    """(by, base, intervals, dropped, worst, worst_t): intervals over factor times the base, and the longest."""
    stepped = gaps(rows, by).where("dt IS NOT NULL").join(base_interval(rows, by), by)
    return stepped.groupBy(*by, "base").agg(
        F.count("*").alias("intervals"), F.count_if(F.col("dt") > factor * F.col("base")).alias("dropped"), F.max("dt").alias("worst"), F.max_by("t", F.struct("dt", -F.unix_micros("t"))).alias("worst_t")
    )


def multiples(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with dt, place, the number of their interval from 0, and multiple, the interval over the base of base_interval; the first of a series has none."""
    stepped = gaps(rows, by).withColumn("place", F.row_number().over(_ordered(by, ["t", "seq"])) - 2).where("dt IS NOT NULL")
    base = base_interval(rows, by)
    return stepped.join(base, by).withColumn("multiple", F.col("dt") / F.nullif(F.col("base"), F.lit(0.0)))


def worst_interval(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, worst, place, t): the largest multiple of each series, where it is, the first of equals."""
    out = multiples(rows, by).where("multiple IS NOT NULL").groupBy(*by).agg(F.max_by(F.struct("multiple", "place", "t"), F.struct("multiple", -F.col("place"))).alias("x"))
    return out.select(*by, F.col("x.multiple").alias("worst"), "x.place", "x.t")


def find_gaps(rows: DataFrame, by: list[str], tolerance: float = 0.5) -> DataFrame:
    """(by, t, place, dt, ratio): intervals that differ from the mean one by more than tolerance of it; series of two rows have none."""
    w = Window.partitionBy(*by)
    stepped = gaps(rows, by).withColumn("place", F.row_number().over(_ordered(by, ["t", "seq"])) - 2).withColumn("_n", F.count("*").over(w))
    mean = (F.unix_micros(F.max("t").over(w)) - F.unix_micros(F.min("t").over(w))) / 1e6 / F.nullif(F.col("_n") - 1, F.lit(0))
    out = stepped.withColumn("_mean", mean).where("dt IS NOT NULL AND _n >= 3").where(F.abs(F.col("dt") - F.col("_mean")) > tolerance * F.col("_mean"))
    return out.select(*by, "t", "place", "dt", (F.col("dt") / F.nullif(F.col("_mean"), F.lit(0.0))).alias("ratio"))


def interval_histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio, n): intervals over the base, in tenths."""
    stepped = gaps(rows, by).where("dt IS NOT NULL").join(base_interval(rows, by), by).where("base > 0")
    return stepped.groupBy(*by, (F.floor(F.col("dt") / F.col("base") * 10 + 0.5) / 10).alias("ratio")).agg(F.count("*").alias("n"))


def count_windows(rows: DataFrame, by: list[str], size: int, value: str) -> DataFrame:
    """(by, window_no, mean, low, high) of windows of size rows, a short last one left out."""
    numbered = rows.withColumn("window_no", F.floor((F.row_number().over(_ordered(by, ["t", "seq"])) - 1) / size))
    return numbered.groupBy(*by, "window_no").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("n") == size).drop("n")


def label_runs(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, run_no, label, n, t_from, t_to): runs of one label."""
    w = _ordered(by, ["t", "seq"])
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w))
    return numbered.groupBy(*by, "run_no").agg(F.first(label).alias(label), F.count("*").alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"))


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(_ordered(by, ["t", "seq"]))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))


def degradation_ratio(rows: DataFrame, by: list[str], value: str, share: float = 0.2) -> DataFrame:
    """(by, ratio): median of the last share over that of the first."""
    placed = _placed(rows, by)
    k = F.greatest(F.lit(1), whole_share(F.col("_n"), share))
    out = placed.groupBy(*by).agg(F.median(F.when(F.col("_i") <= k, F.col(value))).alias("head"), F.median(F.when(F.col("_i") > F.col("_n") - k, F.col(value))).alias("tail"))
    return out.select(*by, (F.col("tail") / F.when(F.col("head") != 0, F.col("head"))).alias("ratio"))


def life_head_z(rows: DataFrame, by: list[str], value: str, share: float = 0.1, least: int = 30) -> DataFrame:
    """rows with z against median and IQR of the first share of a life, least rows at least."""
    placed = _placed(rows, by)
    head = placed.where(F.col("_i") <= F.greatest(F.lit(least), whole_share(F.col("_n"), share)))
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    base = head.groupBy(*by).agg(p.alias("p")).select(*by, F.col("p")[1].alias("median"), ((F.col("p")[2] - F.col("p")[0]) / 1.349).alias("scale"))
    z = (F.col(value) - F.col("median")) / F.greatest(F.col("scale"), F.lit(1e-9))
    return placed.join(base, by).withColumn("z", z).drop("_i", "_n", "median", "scale")


def near_baseline(rows: DataFrame, by: list[str], value: str, least: int = 10) -> DataFrame:
    """(by, median, iqr, n) of normal rows (label 0) before the first fault (label > 0), if there are least."""
    onset = rows.where("label > 0").groupBy(*by).agg(F.min("t").alias("onset"))
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where("label = 0").join(onset, by).where("t < onset").groupBy(*by).agg(p.alias("p"), F.count(value).alias("n")).where(F.col("n") >= least)
    return out.select(*by, F.col("p")[1].alias("median"), (F.col("p")[2] - F.col("p")[0]).alias("iqr"), "n")


def half_split_false_alarm(rows: DataFrame, by: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    """(by, false_alarm): the first half builds a baseline, the share of the second half with z at or above threshold is the rate."""
    placed = _placed(rows, by)
    half = F.floor(F.col("_n") / 2)
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    base = placed.where(F.col("_i") <= half).groupBy(*by).agg(p.alias("p")).select(*by, F.col("p")[1].alias("median"), F.greatest((F.col("p")[2] - F.col("p")[0]) / 1.349, F.lit(1e-9)).alias("scale"))
    second = placed.where(F.col("_i") > half).join(base, by)
    return second.groupBy(*by).agg(F.avg(((F.col(value) - F.col("median")) / F.col("scale") >= threshold).cast("double")).alias("false_alarm"))


def _mid_rank(by: list[str], value: str) -> Column:
    w = Window.partitionBy(*by)
    same = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(w.orderBy(value)) + (same - 1) / 2


def spearman(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, rho): rank correlation of a value with time, ties at their mean rank."""
    ranked = rows.withColumn("_x", F.unix_micros("t")).where(F.col(value).isNotNull())
    ranked = ranked.withColumn("_rt", _mid_rank(by, "_x")).withColumn("_rv", _mid_rank(by, value))
    return ranked.groupBy(*by).agg(F.corr("_rt", "_rv").alias("rho"))


def single_feature_auc(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, auc): how well a value alone tells the second half from the first, folded above one half."""
    placed = _placed(rows.where(F.col(value).isNotNull()), by).withColumn("_r", _mid_rank(by, value))
    late = F.col("_i") > F.floor(F.col("_n") / 2)
    s = placed.groupBy(*by).agg(F.sum(F.when(late, F.col("_r"))).alias("r"), F.count_if(late).alias("n1"), F.count_if(~late).alias("n0"))
    auc = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return s.where("n1 > 0 AND n0 > 0").select(*by, F.greatest(auc, 1 - auc).alias("auc"))


def baseline_age(end: Column, now: Column) -> Column:
    """Hours since a baseline's end, days from two days on, in words."""
    h = (F.unix_micros(now) - F.unix_micros(end)) / 3.6e9
    return F.when(h < 0, "later than the frame").when(h < 48, F.concat(F.floor(h).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit(" d")))


def where_in_segment(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with minutes since their segment's first window."""
    return rows.withColumn("minutes_in", (F.unix_micros("window_start") - F.unix_micros(F.min("window_start").over(Window.partitionBy(*by)))) / 6e7)


def last_written(findings: DataFrame, by: list[str]) -> DataFrame:
    """findings, with what an output not written last held and when: its own earlier value and time."""
    w = _ordered(by, ["t"]).rowsBetween(Window.unboundedPreceding, 0)
    held = F.struct("value", "t")
    return findings.withColumn("_h", F.last(F.when(F.col("value").isNotNull(), held), ignorenulls=True).over(w)).withColumn("held_value", F.col("_h.value")).withColumn("held_t", F.col("_h.t")).drop("_h")
