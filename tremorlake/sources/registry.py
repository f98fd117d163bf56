"""A registry of trained models: artifact first, then one row about it; which one is active is a log of its own.

Under one folder: artifacts/<id> holds a saved model, models/id=<id> its row, activations/ one small file for each switch. An id is a hash
of what the model was asked to be, so a job that runs again after a failure writes over its own leavings and adds nothing twice. Nothing
that fails halfway can be seen: an artifact without a row is no model, and a switch is one file that is there or is not.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

MODEL = """id string, domain string, kind string, binding string, name string, algo string, size long, sha256 string, files long, sample_count long,
  frame_count long, feature_count long, accuracy double, label_counts string, skipped_count long, summary string, origin string, data_origin string, created_at timestamp"""
SWITCH = "domain string, kind string, binding string, id string, at_us long"
REQUEST = ("domain", "kind", "binding", "name", "algo", "origin", "data_origin")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def models(spark: SparkSession, root: str) -> DataFrame:
    """A row for each model whose artifact is whole."""
    return _read(spark, f"{root}/models", MODEL)


def model_id(request: dict, fingerprint: str) -> str:
    """The id of a request: what it asks for, and a fingerprint of what it is trained on."""
    text = json.dumps([*(request.get(k) or "" for k in REQUEST), fingerprint])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def fingerprint(rows: DataFrame) -> str:
    """A number of the rows as a multiset: the same for the same rows, in whatever order they come."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    n, a, b = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{n}:{a}:{b}"


def store(spark: SparkSession, root: str, model, request: dict, trained_on: str, facts: dict) -> str:
    """Save model (anything with write().overwrite().save) and then its row; its id. A model of that id that is whole already is left as it is.

    request has the keys of REQUEST, kind, name and origin not empty; facts those columns of MODEL that training knows.
    """
    blank = [k for k in ("domain", "kind", "name", "origin") if not str(request.get(k) or "").strip()]
    if blank:
        raise ValueError(f"a model needs {', '.join(blank)}")
    own = model_id(request, trained_on)
    if not models(spark, root).where(F.col("id") == own).isEmpty():
        return own
    at = f"{root}/artifacts/{own}"
    model.write().overwrite().save(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    each = files.select(F.col("length"), F.sha2("content", 256).alias("h"))
    told = each.agg(F.sum("length").alias("size"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))), 256).alias("sha256"), F.count("*").alias("files")).first()
    row = {k: request.get(k) or "" for k in REQUEST} | facts | {"id": own, "size": told["size"], "sha256": told["sha256"], "files": told["files"]}
    names = [c.split()[0] for c in MODEL.replace("\n", " ").split(",")]
    values = spark.createDataFrame([[row.get(k) for k in names[:-1]]], MODEL.rpartition(",")[0]).withColumn("created_at", F.current_timestamp())
    values.coalesce(1).write.mode("overwrite").parquet(f"{root}/models/id={own}")
    return own


def activate(spark: SparkSession, root: str, own: str) -> bool:
    """Make a model the active one of its domain, kind and binding; False if it is that already. An unknown id is an error."""
    found = models(spark, root).where(F.col("id") == own).select("domain", "kind", "binding").first()
    if found is None:
        raise ValueError(f"no model {own}")
    scope = active(spark, root).where((F.col("domain") == found.domain) & (F.col("kind") == found.kind) & (F.col("binding") == found.binding))
    if not scope.where(F.col("id") == own).isEmpty():
        return False
    last = _read(spark, f"{root}/activations", SWITCH).agg(F.max("at_us")).first()[0] or 0
    row = spark.createDataFrame([(*found, own, max(time.time_ns() // 1000, last + 1))], SWITCH)
    row.coalesce(1).write.mode("append").parquet(f"{root}/activations")
    return True


def active(spark: SparkSession, root: str) -> DataFrame:
    """(domain, kind, binding, id, since): one model for each scope, that of its latest switch, ties by id."""
    switches = _read(spark, f"{root}/activations", SWITCH).join(models(spark, root).select("id"), "id", "left_semi")
    last = switches.groupBy("domain", "kind", "binding").agg(F.max(F.struct("at_us", "id")).alias("x"))
    return last.select("domain", "kind", "binding", "x.id", F.timestamp_micros("x.at_us").alias("since"))


def registered(spark: SparkSession, root: str) -> DataFrame:
    """All models with whether they are active."""
    now = active(spark, root).select("id", F.lit(True).alias("active"))
    return models(spark, root).join(now, "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def active_for(spark: SparkSession, root: str, domain: str, kind: str, binding: str) -> Row | None:
    """The active model of a binding, else that of the whole domain (binding ''), with the path of its artifact."""
    rows = active(spark, root).where((F.col("domain") == domain) & (F.col("kind") == kind) & F.col("binding").isin(binding, ""))
    own = rows.orderBy(F.length("binding").desc()).first()
    return None if own is None else Row(id=own.id, binding=own.binding, path=f"{root}/artifacts/{own.id}")


def load_active(spark: SparkSession, root: str, domain: str, kind: str, binding: str) -> PipelineModel | None:
    own = active_for(spark, root, domain, kind, binding)
    return None if own is None else PipelineModel.load(own.path)


def train_and_store(spark: SparkSession, root: str, frames: DataFrame, request: dict, fit: Callable[[DataFrame], tuple[object, dict]]) -> str:
    """Train on labelled frames (sample_id, label, more) and store the model with what it was trained on; not active until activate.

    fit gives the model and the facts that only it knows, such as accuracy (null where none was measured), feature_count and summary.
    """
    model, facts = fit(frames)
    counts = frames.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # one a label
    known = {
        "frame_count": sum(r.n for r in counts),
        "sample_count": frames.agg(F.count_distinct("sample_id")).first()[0],
        "label_counts": json.dumps({str(r.label): r.n for r in counts}, ensure_ascii=False),
    }
    return store(spark, root, model, request, fingerprint(frames), known | facts)
