"""Reports on models: confusion, gates, baselines, splits, remaining life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import whole_share
from .ranking import quantile


def classification_report(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, support, predicted, hits, precision, recall) of rows (truth, prediction); null where undefined."""
    by = by or []
    t = scored.groupBy(*by, F.col("truth").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("prediction")).alias("hits"))
    p = scored.groupBy(*by, F.col("prediction").alias("label")).agg(F.count("*").alias("predicted"))
    out = t.join(p, [*by, "label"], "full").na.fill(0, ["support", "hits", "predicted"])
    share = lambda c: F.col("hits") / F.nullif(F.col(c), F.lit(0))
    return out.withColumn("precision", share("predicted")).withColumn("recall", share("support"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("truth", "prediction").agg(F.count("*").alias("n"))


def class_gates(frames: DataFrame, by: list[str], least_frames: int = 10, least_samples: int = 2) -> DataFrame:
    """(by, classes, reason): two classes at least, each of enough frames and samples, else why not."""
    each = frames.groupBy(*by, "label").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("k"))
    out = each.groupBy(*by).agg(F.count("*").alias("classes"), F.min("n").alias("n"), F.min("k").alias("k"))
    reason = F.when(F.col("classes") < 2, "one class").when(F.col("n") < least_frames, "few frames").when(F.col("k") < least_samples, "few samples")
    return out.select(*by, "classes", reason.alias("reason"))


def grouped_holdout(samples: DataFrame, share: float = 0.25) -> DataFrame:
    """samples (sample_id, label) with held_out: of each label whole samples, one at least and never all."""
    each = samples.select("label", "sample_id").distinct()
    w = Window.partitionBy("label")
    ranked = each.withColumn("r", F.row_number().over(w.orderBy(F.md5(F.col("sample_id").cast("string")), "sample_id"))).withColumn("n", F.count("*").over(w))
    k = F.least(F.col("n") - 1, F.greatest(F.lit(1), whole_share(F.col("n"), share)))
    return samples.join(ranked.select("label", "sample_id", (F.col("r") <= k).alias("held_out")), ["label", "sample_id"])


def time_block_split(rows: DataFrame, by: list[str], share: float = 0.7) -> DataFrame:
    """rows with train: the first share of each segment."""
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy("t", "seq"))).withColumn("_n", F.count("*").over(w))
    return placed.withColumn("train", F.col("_i") <= whole_share(F.col("_n"), share)).drop("_i", "_n")


def speed_split(rows: DataFrame, speed: str, share: float = 0.7) -> DataFrame:
    """rows with train: speeds up to the quantile."""
    cut = quantile(rows, speed, share)
    return rows.withColumn("train", F.col(speed) <= F.lit(cut).cast("double"))


def majority_baseline(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, share) of the most frequent label."""
    return rows.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n")).alias("share"))


def constant_baseline(rows: DataFrame, by: list[str], target: str, train: Column) -> DataFrame:
    """(by, train_mean, rmse, own_rmse): error on the rest of predicting the train mean, and its own mean."""
    mean = rows.where(train).groupBy(*by).agg(F.avg(target).alias("train_mean"))
    rest = rows.where(~train).join(mean, by)
    y, m = F.col(target), F.col("train_mean")
    return rest.groupBy(*by, "train_mean").agg(F.sqrt(F.avg((y - m) * (y - m))).alias("rmse"), F.stddev_pop(target).alias("own_rmse"))


def trigger_rate(segments: DataFrame, score: str, threshold: float) -> DataFrame:
    """(class, files, rate, over_half): mean share of triggered segments of a class' files and share of files above one half."""
    each = segments.groupBy("class", "file").agg(F.avg((F.col(score) >= threshold).cast("double")).alias("rate"))
    return each.groupBy("class").agg(F.count("*").alias("files"), F.avg("rate").alias("rate"), F.avg((F.col("rate") > 0.5).cast("double")).alias("over_half"))


def speed_detrend(rows: DataFrame, by: list[str], value: str, rpm: str, least: int = 5, least_range: float = 0.05) -> DataFrame:
    """rows with log residual after log v = a + b log rpm on normal rows; no detrending on few rows or a narrow range."""
    x, y = F.ln(F.col(rpm)), F.ln(F.col(value))
    usable = (F.col(rpm) > 0) & (F.col(value) > 0)
    normal = rows.where(usable & (F.col("label") == 0))
    fit = normal.groupBy(*by).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(y).alias("mean"), F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("range"))
    fitted = (F.col("n") > least) & (F.col("range") > least_range)
    out = rows.where(usable).join(fit, by)
    return out.withColumn("residual", y - F.when(fitted, F.col("a") + F.col("b") * x).otherwise(F.col("mean"))).withColumn("detrended", fitted).drop("a", "b", "mean", "n", "range")


def hit_and_false_alarm(rows: DataFrame, by: list[str], z: str, threshold: float = 3.0) -> DataFrame:
    over = (F.col(z) >= threshold).cast("double")
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("label") > 0, over)).alias("hit"), F.avg(F.when(F.col("label") == 0, over)).alias("false_alarm"))


def same_period(fault: DataFrame, healthy: DataFrame, by: list[str]) -> DataFrame:
    """healthy rows between the first and last fault of their case."""
    span = fault.groupBy(*by).agg(F.min("t").alias("f0"), F.max("t").alias("f1"))
    return healthy.join(span, by).where("t BETWEEN f0 AND f1").drop("f0", "f1")


def rul_labels(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with age in days, life in days, and the shares of life consumed and remaining."""
    w = Window.partitionBy(*by)
    age = (F.unix_micros("t") - F.unix_micros(F.min("t").over(w))) / 8.64e10
    out = rows.withColumn("age_days", age).withColumn("life_days", F.max("age_days").over(w))
    used = F.col("age_days") / F.nullif(F.col("life_days"), F.lit(0.0))
    return out.withColumn("consumed", used).withColumn("remaining", 1 - used)


def remaining_of_truncated(full: DataFrame, cut: DataFrame, by: list[str], seconds: float = 10.0) -> DataFrame:
    """(by, remaining_s): frames that the truncated run lacks, in seconds."""
    a, b = full.groupBy(*by).agg(F.count("*").alias("n")), cut.groupBy(*by).agg(F.count("*").alias("k"))
    return a.join(b, by).select(*by, ((F.col("n") - F.col("k")) * seconds).alias("remaining_s"))


def weibull_eta(lives: DataFrame, by: list[str], beta: float, life: str = "life", failed: str = "failed") -> DataFrame:
    """(by, eta): (sum of life**beta over the number of failures) ** (1 / beta)."""
    s = lives.groupBy(*by).agg(F.sum(F.pow(F.col(life), F.lit(beta))).alias("s"), F.count_if(F.col(failed)).alias("r"))
    return s.where("r > 0").select(*by, F.pow(F.col("s") / F.col("r"), F.lit(1 / beta)).alias("eta"))


def weibull_cdf_gap(rows: DataFrame, by: list[str], a: str, b: str, eta: float, beta: float) -> DataFrame:
    """(by, gap): root mean square of the difference of the two times' distribution values."""
    cdf = lambda c: 1 - F.exp(-F.pow(F.greatest(F.col(c), F.lit(0.0)) / eta, F.lit(beta)))
    return rows.groupBy(*by).agg(F.sqrt(F.avg(F.pow(cdf(a) - cdf(b), F.lit(2.0)))).alias("gap"))


def minmax(rows: DataFrame, by: list[str], columns: list[str], train: Column) -> DataFrame:
    """rows with each column scaled by its least and largest in the training part, clamped to 0..1; null where they are equal."""
    fit = rows.where(train).groupBy(*by).agg(*[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns])
    out = rows.join(fit, by)
    for c in columns:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        out = out.withColumn(f"{c}_scaled", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))))
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("lo", "hi")])


def zscore(rows: DataFrame, by: list[str], columns: list[str], train: Column) -> DataFrame:
    """rows with each column in standard deviations from its mean, both of the training part; null where the deviation is not positive."""
    fit = rows.where(train).groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])
    out = rows.join(fit, by)
    for c in columns:
        std = F.col(f"{c}_std")
        out = out.withColumn(f"{c}_z", F.when(std > 0, (F.col(c) - F.col(f"{c}_mean")) / std))
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("mean", "std")])


def softmax_if_needed(scores: Column) -> Column:
    """The scores if they are probabilities already (none negative, sum within a thousandth of 1), else their softmax."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    done = F.forall(scores, lambda x: x >= 0) & (F.abs(total - 1) <= 1e-3)
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.when(done, scores).otherwise(F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def arg_max(scores: Column) -> Column:
    """The position of the largest score, the first on ties."""
    return F.array_position(scores, F.array_max(scores)) - 1


def algorithm_mismatch(wanted: Column, artifact: Column) -> Column:
    """config_incomplete if the binding's algorithm is not that of its model, model_not_loaded without one, else ok."""
    return F.when(artifact.isNull(), "model_not_loaded").when(wanted != artifact, "config_incomplete").otherwise("ok")
