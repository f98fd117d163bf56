"""Writing findings and models, and giving points stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quality import finite, status_code
from .shared import written

A_SLOT = 500_000


def findings_to_values(findings: DataFrame) -> DataFrame:
    """Findings as point values: a null value only as a bad anchor, non-finite numbers refused, time the finding's own."""
    v = finite(F.col("value"))
    bad = (F.col("quality") == "ok") & v.isNull()
    rows = findings.where(F.col("t").isNotNull() & ~(F.col("value").isNotNull() & v.isNull()) & ~bad)
    return rows.withColumn("status_code", status_code(F.col("quality"))).withColumn("value", F.when(F.col("quality") == "ok", v))


def write_findings(findings: DataFrame, path: str) -> None:
    """Overwrite the days that findings hold; a replay of a day leaves one copy."""
    rows = findings_to_values(findings).withColumn("day", F.to_date("t")).dropDuplicates(["point_id", "t"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def model_row(models: DataFrame, payload: Column) -> DataFrame:
    """Metadata of model files: size, sha-256, origin as given, accuracy null where there is none."""
    return models.withColumn("size", F.octet_length(payload)).withColumn("sha256", F.sha2(payload, 256)).withColumn("active", F.lit(False))


def import_check(new: DataFrame, known: DataFrame) -> DataFrame:
    """new artifacts (domain, kind, sha256, origin, name) with a reject reason, null if they may be imported."""
    seen = known.select("domain", "kind", "sha256").distinct().withColumn("seen", F.lit(True))
    out = new.join(seen, ["domain", "kind", "sha256"], "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return out.withColumn("reject", F.when(F.col("seen"), "duplicate").when(blank("origin") | blank("name"), "provenance missing")).drop("seen")


def allocate_point_ids(declared: DataFrame, known: DataFrame, keys: list[str], containers: DataFrame | None = None) -> DataFrame:
    """Ids for the declared keys that known (keys, point_id) lacks, above all ids ever given, those of containers included.

    New keys get consecutive ids by rank: within slots of some A_SLOT keys, shifted by the sizes of the slots before, so no
    single task ranks them all.
    """
    new = declared.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
    used = known.select("point_id") if containers is None else known.select("point_id").union(containers.select("point_id"))
    top = used.agg(F.coalesce(F.max("point_id"), F.lit(0)).alias("top"))
    new = written(new, "new-keys")
    slots = max(1, -(-new.count() // A_SLOT))
    new = new.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(slots)))
    sizes = new.groupBy("slot").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = new.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy(*keys)))
    return ranked.join(before, "slot").crossJoin(F.broadcast(top)).select(*keys, (F.col("top") + F.col("before") + F.col("r")).alias("point_id"))
