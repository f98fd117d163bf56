"""Training and scoring of fault classifiers and remaining-life models on Spark ML, and press curves."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import written
from .evaluation import arg_max, grouped_holdout


def usable_frames(frames: DataFrame, features: list[str]) -> DataFrame:
    """Labelled frames (label, sample_id, features) without those that miss a feature, with held_out by whole samples and a weight that balances labels.

    Written, as each fit reads them several times.
    """
    usable = written(grouped_holdout(frames.dropna(subset=[*features, "label"])), "frames")
    total = usable.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    weight = usable.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("label", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))
    return usable.join(weight, "label")


def fit_fault_classifier(usable: DataFrame, features: list[str], seed: int = 7, trees: int = 100) -> PipelineModel:
    """A forest on usable_frames."""
    stages = [
        StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc", handleInvalid="skip"),
        VectorAssembler(inputCols=features, outputCol="feature_vector"),
        RandomForestClassifier(labelCol="class", featuresCol="feature_vector", numTrees=trees, maxDepth=6, minInstancesPerNode=2, maxBins=32, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed),
    ]
    return Pipeline(stages=stages).fit(usable)


def evaluate_fault_classifier(usable: DataFrame, features: list[str], seed: int = 7, trees: int = 100) -> DataFrame:
    """(truth, prediction) of the held-out rows of usable_frames by a forest on the others."""
    tried = fit_fault_classifier(usable.where("NOT held_out"), features, seed, trees)
    return score_fault_class(tried, usable.where("held_out"), features).select(F.col("label").alias("truth"), F.col("fault_class").alias("prediction"))


def train_fault_classifier(frames: DataFrame, features: list[str], seed: int = 7, trees: int = 100) -> tuple[PipelineModel, dict]:
    """A forest fitted on all usable frames after evaluation on held-out samples, and what its registry row tells: a fit for registry.train_and_store."""
    usable = usable_frames(frames, features)
    scored = evaluate_fault_classifier(usable, features, seed, trees)
    right, tested = scored.agg(F.avg((F.col("truth") == F.col("prediction")).cast("double")), F.count("*")).first()
    skipped = frames.count() - usable.count()
    facts = {"accuracy": right, "feature_count": len(features), "skipped_count": skipped, "summary": f"{trees} trees, {tested} frames of held-out samples tested"}
    return fit_fault_classifier(usable, features, seed, trees), facts


def score_fault_class(model: PipelineModel, frames: DataFrame, features: list[str]) -> DataFrame:
    """frames with fault_class and probability; insufficient_samples where a feature is missing."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    ok = frames.dropna(subset=features)
    p = model.stages[2].transform(model.stages[1].transform(ok)).withColumn("p", vector_to_array("probability"))
    p = p.withColumn("fault_class", F.get(names, arg_max(F.col("p")).cast("int"))).withColumn("fault_probability", F.round(F.array_max("p"), 3)).withColumn("quality", F.lit("ok"))
    kept = [*frames.columns, "fault_class", "fault_probability", "quality"]
    rest = frames.where(" OR ".join(f"`{c}` IS NULL" for c in features))
    rest = rest.withColumn("fault_class", F.lit(None).cast("string")).withColumn("fault_probability", F.lit(None).cast("double")).withColumn("quality", F.lit("insufficient_samples"))
    return p.select(kept).unionByName(rest.select(kept))


def train_remaining_life(rows: DataFrame, features: list[str], target: str, machine: str, share: float = 0.3) -> DataFrame:
    """(machines, rmse, constant_rmse) on whole held-out machines, against predicting the train mean."""
    split = grouped_holdout(rows.dropna(subset=[*features, target]).withColumn("sample_id", F.col(machine)).withColumn("label", F.lit("all")), share)
    stages = [VectorAssembler(inputCols=features, outputCol="x"), LinearRegression(labelCol=target, featuresCol="x", regParam=0.1)]
    model = Pipeline(stages=stages).fit(split.where("NOT held_out"))
    mean = split.where("NOT held_out").agg(F.avg(target).alias("m"))
    tested = model.transform(split.where("held_out")).crossJoin(F.broadcast(mean))
    y = F.col(target)
    return tested.agg(F.count_distinct(machine).alias("machines"), F.sqrt(F.avg((y - F.col("prediction")) ** 2)).alias("rmse"), F.sqrt(F.avg((y - F.col("m")) ** 2)).alias("constant_rmse"))


def press_features(press: DataFrame) -> DataFrame:
    """press (position, velocity, force arrays) with peak force, stroke, points and quality."""
    n = F.size("position")
    ok = (n > 0) & (n == F.size("velocity")) & (n == F.size("force"))
    ok = F.coalesce(ok, F.lit(False))
    out = press.withColumn("points", n).withColumn("quality", F.when(ok, "ok").otherwise("input_bad"))
    return out.withColumn("peak_force", F.when(ok, F.array_max("force"))).withColumn("stroke", F.when(ok, F.try_element_at("position", F.lit(-1)) - F.col("position")[0]))


def resample_press(press: DataFrame, n: int = 128) -> DataFrame:
    """press with position, velocity and force at n equal steps of displacement, linear between points.

    Null where a curve is null, empty, of another length, or holds a null or NaN, or where the displacement has no span. Of points of one
    displacement, the last as recorded is the one that later steps start from. n is 2 at least.
    """
    curves = ("position", "velocity", "force")
    sound = F.greatest(*[F.size(c) for c in curves]) == F.least(*[F.size(c) for c in curves])
    for c in curves:
        sound = sound & ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")))
    point = lambda p, i: F.struct(p.cast("double").alias("p"), i.alias("i"), F.get("velocity", i).cast("double").alias("v"), F.get("force", i).cast("double").alias("f"))
    out = press.withColumn("_points", F.when(sound & (F.array_max("position") > F.array_min("position")), F.array_sort(F.transform("position", point))))
    first, last = F.get("_points", 0)["p"], F.element_at("_points", -1)["p"]
    out = out.withColumn("position_n", F.transform(F.when(F.col("_points").isNotNull(), F.sequence(F.lit(0), F.lit(n - 1))), lambda k: first + k * (last - first) / (n - 1)))
    out = out.withColumn("_at", F.transform("position_n", lambda x: F.size(F.filter("_points", lambda p: p["p"] <= x)) - 1))

    def between(c: str):
        def value(x, k):
            here, after = F.get("_points", F.get("_at", k)), F.get("_points", F.get("_at", k) + 1)
            return F.when(after.isNull(), here[c]).otherwise(here[c] + (after[c] - here[c]) / (after["p"] - here["p"]) * (x - here["p"]))

        return F.transform("position_n", value)

    return out.withColumn("velocity_n", between("v")).withColumn("force_n", between("f")).drop("_points", "_at")
