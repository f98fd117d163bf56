"""What feature sets tell apart: the same classification tasks on several feature sets, over repeated hold-outs, with chance and a null control.

A task is a set of labels; rows of it are split by whole groups once a seed, or in time. The null control asks the same of one class's first
half against its second: what it gains over chance is drift, and has to be taken off what other tasks gain. Seeds, tasks and feature
sets are columns, so all splits, fits of the Gaussian model, scores and medians are one plan.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import whole_share

LEAST_VARIANCE = 1e-9


def task_rows(rows: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """rows (label, more) once for each task that has their label, with the column task."""
    members = F.array(*[F.struct(F.lit(name).alias("task"), F.array(*[F.lit(x) for x in labels]).alias("labels")) for name, labels in tasks.items()])
    own = F.filter(members, lambda m: F.array_contains(m["labels"], F.col("label")))
    return rows.withColumn("task", F.explode(F.transform(own, lambda m: m["task"])))


def null_control(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows of task null control: the label tells the first half of each class, in order, from the second."""
    w = Window.partitionBy(*by, "label")
    place = F.row_number().over(w.orderBy(*order))
    half = F.when(place <= F.floor(F.count("*").over(w) / 2), "first half").otherwise("second half")
    return rows.withColumn("half", half).withColumn("task", F.concat(F.lit("null control of "), "label")).withColumn("label", F.col("half")).drop("half")


def repeated_holdout(rows: DataFrame, seeds: list[int], share: float = 0.25) -> DataFrame:
    """rows (task, label, group, more) once a seed, with train: of each task and label whole groups are held out, one at least and never all.

    Which groups goes by a hash of group and seed, so a seed means the same split everywhere.
    """
    groups = rows.select("task", "label", "group").distinct().withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    w = Window.partitionBy("task", "label", "seed")
    turn = F.md5(F.concat_ws(":", "seed", "group"))
    r, n = F.row_number().over(w.orderBy(turn, "group")), F.count("*").over(w)
    held = r <= F.least(n - 1, F.greatest(F.lit(1), whole_share(n, share)))
    return rows.join(groups.select("task", "label", "group", "seed", (~held).alias("train")), ["task", "label", "group"])


def feature_rows(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """rows once for each feature set: feature_set and its values, x; rows with a missing value in a set are left out of it."""
    each = F.array(*[F.struct(F.lit(name).alias("feature_set"), x.cast("array<double>").alias("x")) for name, x in sets.items()])
    out = rows.select("*", F.inline(each))
    return out.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


KEYS = ["task", "feature_set", "seed"]


def gaussian_scores(rows: DataFrame) -> DataFrame:
    """(KEYS, truth, prediction) of the rows not in train, by a Gaussian of each feature and label fitted on the others, all fits in one plan.

    rows: KEYS, label, train, x. Ties go to the label that sorts first.
    """
    long = rows.where("train").select(*KEYS, "label", F.posexplode("x").alias("i", "v"))
    each = long.groupBy(*KEYS, "label", "i").agg(F.avg("v").alias("m"), F.greatest(F.var_pop("v"), F.lit(LEAST_VARIANCE)).alias("s"), F.count("*").alias("n"))
    fitted = each.groupBy(*KEYS, "label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("g"), F.max("n").alias("n"))
    fits = fitted.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("label", "g", "n"))).alias("fits"), F.sum("n").alias("total"))

    def likelihood(fit: Column) -> Column:
        terms = F.zip_with("x", fit["g"], lambda v, g: -0.5 * F.log(2 * F.pi() * g["s"]) - (v - g["m"]) * (v - g["m"]) / (2 * g["s"]))
        return F.aggregate(terms, F.log(fit["n"] / F.col("total")), lambda a, t: a + t)

    tested = rows.where("NOT train").join(fits, KEYS)
    scores = F.transform("fits", likelihood)
    best = F.element_at(F.col("fits.label"), F.array_position(scores, F.array_max(scores)).cast("int"))
    return tested.select(*KEYS, F.col("label").alias("truth"), best.alias("prediction"))


def forest_scores(rows: DataFrame, trees: int = 50, depth: int = 6, at_once: int = 4) -> DataFrame:
    """The same by a random forest for each task, feature set and seed; at_once of these fits run side by side.

    rows should be kept or written before, as each fit reads its share of them.
    """
    keys = sorted(tuple(r) for r in rows.select(*KEYS).distinct().collect())  # one a fit

    def one(key: tuple) -> DataFrame:
        own = rows
        for name, value in zip(KEYS, key):
            own = own.where(F.col(name) == F.lit(value))
        own = own.select("label", "train", array_to_vector("x").alias("v"))
        stages = [StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc", handleInvalid="skip"), RandomForestClassifier(labelCol="class", featuresCol="v", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=int(key[2]))]
        model = Pipeline(stages=stages).fit(own.where("train"))
        names = F.array(*[F.lit(x) for x in model.stages[0].labels])
        scored = model.stages[1].transform(own.where("NOT train"))
        given = [F.lit(v).alias(k) for k, v in zip(KEYS, key)]
        return scored.select(*given, F.col("label").alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("prediction"))

    with ThreadPool(max(1, at_once)) as pool:
        parts = pool.map(one, keys)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def study_table(scores: DataFrame) -> DataFrame:
    """(task, feature_set, seeds, tested, accuracy, chance, gain): medians over seeds; chance is the share of the most frequent truth."""
    right = F.avg((F.col("truth") == F.col("prediction")).cast("double"))
    largest = scores.groupBy(*KEYS, "truth").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.max("n").alias("most"), F.sum("n").alias("tested"))
    each = scores.groupBy(*KEYS).agg(right.alias("accuracy")).join(largest, KEYS).withColumn("chance", F.col("most") / F.col("tested"))
    out = each.groupBy("task", "feature_set").agg(F.count("*").alias("seeds"), F.median("tested").alias("tested"), F.median("accuracy").alias("accuracy"), F.median("chance").alias("chance"))
    return out.withColumn("gain", F.col("accuracy") - F.col("chance"))
