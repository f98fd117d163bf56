"""Annotations, training sets and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def annotations_overlapping(annotations: DataFrame, ranges: DataFrame, bucket_s: int = 86400 * 4) -> DataFrame:
    """ranges (range_id, binding, r_from, r_to) with the annotations of their binding that overlap: t_to > r_from and t_from < r_to."""
    of = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    a = annotations.withColumn("bucket", F.explode(F.sequence(of("t_from"), of("t_to"))))
    r = ranges.withColumn("bucket", F.explode(F.sequence(of("r_from"), of("r_to"))))
    met = r.join(a, ["binding", "bucket"]).where((F.col("t_to") > F.col("r_from")) & (F.col("t_from") < F.col("r_to")))
    # a pair meets in every bucket that both touch; the first of them counts
    return met.where(F.col("bucket") == F.greatest(of("t_from"), of("r_from"))).drop("bucket")


def add_to_dataset(annotations: DataFrame, samples: DataFrame, dataset_id: Column) -> DataFrame:
    """New samples of a training set: the annotations that it does not hold yet, with label and origin as they are now."""
    new = annotations.withColumn("dataset_id", dataset_id)
    new = new.join(samples.select("dataset_id", "annotation_id"), ["dataset_id", "annotation_id"], "left_anti")
    return new.select("dataset_id", "annotation_id", "binding", "t_from", "t_to", "label", "data_origin")


def copy_samples(samples: DataFrame, source: int, target: int) -> DataFrame:
    """Samples of one set for another, but those whose annotation it has; samples without an annotation always go."""
    held = samples.where(F.col("dataset_id") == target).select("annotation_id")
    return samples.where(F.col("dataset_id") == source).join(held, "annotation_id", "left_anti").withColumn("dataset_id", F.lit(target))


def unlink_deleted(samples: DataFrame, deleted: DataFrame) -> DataFrame:
    """samples whose annotation is gone keep everything but the link to it."""
    gone = deleted.select("annotation_id").distinct().withColumn("gone", F.lit(True))
    return samples.join(gone, "annotation_id", "left").withColumn("annotation_id", F.when(F.col("gone").isNull(), F.col("annotation_id"))).drop("gone")


def label_counts(samples: DataFrame, by: list[str]) -> DataFrame:
    """Samples by label with their place, the most frequent first, labels in order on ties."""
    n = samples.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "label")))


def effective_origin(snapshot: Column, now: Column) -> Column:
    """The snapshot if there is one, else only `simulated` is inherited; empty for undeclared."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(norm(snapshot) != "", norm(snapshot)).when(norm(now) == "simulated", "simulated").otherwise("")


def fold_origin(rows: DataFrame, by: list[str], origin: str = "origin") -> DataFrame:
    """(by, origin): simulated if any is, the one value if all share it, else undeclared."""
    out = rows.groupBy(*by).agg(F.max((F.col(origin) == "simulated").cast("int")).alias("s"), F.min(origin).alias("lo"), F.max(origin).alias("hi"))
    return out.select(*by, F.when(F.col("s") == 1, "simulated").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("origin"))


def spread_of_origins(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, origins, mixed): how many origins a training set mixes."""
    return rows.groupBy(*by).agg(F.count_distinct("origin").alias("origins")).withColumn("mixed", F.col("origins") > 1)


def active_artifact(bindings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """bindings x kind with the active artifact of the binding, else that of the whole domain (binding '')."""
    active = artifacts.where("active")
    kinds = artifacts.select("domain", "kind").distinct()
    own = active.where("binding <> ''").select("domain", "kind", "binding", F.col("artifact_id").alias("own"))
    whole = active.where("binding = ''").select("domain", "kind", F.col("artifact_id").alias("whole"))
    out = bindings.join(kinds, "domain").join(own, ["domain", "kind", "binding"], "left").join(whole, ["domain", "kind"], "left")
    return out.withColumn("artifact_id", F.coalesce("own", "whole")).drop("own", "whole")


def latest_struct(values: DataFrame, points: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(tag_id, t, value) of each point's last value in the days before now; points without one keep a null."""
    recent = values.where((F.col("t") <= now) & (F.col("t") > now - F.make_interval(days=F.lit(days))))
    last = recent.groupBy("tag_id").agg(F.max("t").alias("t"), F.max_by("value", F.struct("t", "seq")).alias("value"))
    return points.select("tag_id").distinct().join(last, "tag_id", "left")


def pending_deletion(known: DataFrame, snapshot: DataFrame, samples: DataFrame) -> DataFrame:
    """Points that the latest full snapshot lacks, with their last sample's time."""
    gone = known.select("tag_id").distinct().join(snapshot.select("tag_id"), "tag_id", "left_anti")
    return gone.join(samples.groupBy("tag_id").agg(F.max("t").alias("last_t")), "tag_id", "left").withColumn("reason", F.lit("absent from snapshot"))


def conclusion_points(bindings: DataFrame, outputs: DataFrame, points: DataFrame) -> DataFrame:
    """Every output of every binding with its point id, null where it has none, and whether it is in use."""
    out = bindings.select("domain", "binding", "enabled").join(outputs.select("domain", "key"), "domain")
    out = out.join(points.select("domain", "binding", "key", "point_id"), ["domain", "binding", "key"], "left")
    return out.withColumn("in_use", F.col("enabled") & F.col("point_id").isNotNull())


def explain_skips(skipped: DataFrame, by: list[str]) -> DataFrame:
    """Skipped samples by reason, the largest first, with the total of their job."""
    n = skipped.groupBy(*by, "reason").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy(*by))).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "reason")))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def missing_required_roles(bindings: DataFrame, roles: DataFrame, inputs: DataFrame) -> DataFrame:
    """(domain, binding, role) of required inputs that no point is bound to."""
    need = bindings.select("domain", "binding").join(inputs.where("required").select("domain", "role"), "domain")
    return need.join(roles.select("domain", "binding", "role"), ["domain", "binding", "role"], "left_anti")


def undeclared_params(bindings: DataFrame, declared: DataFrame) -> DataFrame:
    """(domain, binding, param) of parameters that the module does not declare."""
    keys = bindings.select("domain", "binding", F.explode(F.map_keys("params")).alias("param"))
    return keys.join(declared.select("domain", "param"), ["domain", "param"], "left_anti")


def undeclared_roles(roles: DataFrame, inputs: DataFrame) -> DataFrame:
    """(domain, binding, role) of roles that the module does not declare."""
    return roles.select("domain", "binding", "role").join(inputs.select("domain", "role"), ["domain", "role"], "left_anti")


#: Fixed value: the longest delay of an alarm in s.
MOST_DELAY_S = 4294967295


def check_bindings(bindings: DataFrame) -> DataFrame:
    """bindings (roles map<string, long>, window_s, interval_s, params map) with violations, an array of what is wrong with them.

    Judged where bindings have them: fields and field_numbers, maps by role; delay_s; image_only, of modules that need no role.
    """
    has = lambda c: c in bindings.columns
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    values = lambda c, wrong: F.coalesce(F.exists(F.map_values(c), lambda v: v.isNull() | wrong(v)), F.lit(False))
    loose = lambda c: F.size(F.array_except(keys(c), keys("roles"))) > 0
    no_role = F.coalesce(F.size("roles"), F.lit(0)) <= 0
    delay = F.col("delay_s") if has("delay_s") else F.lit(0)
    rules = [
        F.when(no_role & ~F.coalesce(F.col("image_only"), F.lit(False)) if has("image_only") else no_role, "no role"),
        F.when(values("roles", lambda v: v <= 0), "point id not positive"),
        F.when(F.col("interval_s") <= 0, "beat not positive"),
        F.when(F.col("window_s") <= 0, "window not positive"),
        F.when(F.exists(keys("params"), lambda k: F.trim(k) == ""), "blank parameter"),
        F.when(values("params", lambda v: F.lit(False)), "parameter without value"),
        F.when(loose("fields"), "field without point") if has("fields") else None,
        F.when(values("fields", lambda v: F.trim(v) == ""), "blank field") if has("fields") else None,
        F.when(loose("field_numbers"), "field number without point") if has("field_numbers") else None,
        F.when(values("field_numbers", lambda v: v <= 0), "field number not positive") if has("field_numbers") else None,
        F.when(F.coalesce((delay < 0) | (delay > MOST_DELAY_S) | (delay != F.floor(delay)), F.lit(True)), "delay out of range") if has("delay_s") else None,
    ]
    return bindings.withColumn("violations", F.array_compact(F.array(*[r for r in rules if r is not None])))


def check_field_binding(roles: DataFrame, fields: DataFrame, inputs: DataFrame) -> DataFrame:
    """Roles bound to struct fields with what is wrong: field by number else by name; scalar; unit and quantity as the input asks;
    inputs of one record on one point."""
    field = F.struct("name", "unit", "quantity", "scalar")
    numbered = fields.select("struct_id", F.col("number").alias("field_number"), field.alias("f1"))
    named = fields.select("struct_id", F.col("name").alias("field_name"), field.alias("f2"))
    out = roles.join(numbered, ["struct_id", "field_number"], "left").join(named, ["struct_id", "field_name"], "left")
    out = out.join(inputs.select("role", F.col("unit").alias("want_unit"), F.col("quantity").alias("want_quantity"), "record_group"), "role")
    f = F.when(F.col("field_number").isNotNull(), F.col("f1")).otherwise(F.col("f2"))
    record = Window.partitionBy("binding", "record_group")
    spread = F.min("tag_id").over(record) < F.max("tag_id").over(record)
    wrong = (
        F.when(f.isNull(), "no such field").when(~f["scalar"], "not a number").when(f["unit"] != F.col("want_unit"), "unit").when(f["quantity"] != F.col("want_quantity"), "quantity")
        .when(F.col("record_group").isNotNull() & spread, "record on several points")
    )
    return out.select("binding", "role", "tag_id", wrong.alias("violation"))


def slow_source_check(bindings: DataFrame, by: list[str]) -> DataFrame:
    """(by, shortest_s, slow) over bindings (by, enabled, raises_alarm, beat_s): the shortest beat of those that are enabled and raise alarms."""
    from ..functions.rules import SLOW_BEAT_S

    on = bindings.where("enabled AND raises_alarm").groupBy(*by).agg(F.min("beat_s").alias("shortest_s"))
    return on.withColumn("slow", F.col("shortest_s") >= SLOW_BEAT_S)


def with_containers(points: DataFrame, containers: DataFrame) -> DataFrame:
    """points (domain, binding) with the container of their binding, else that of their domain, whose binding is null."""
    own = containers.where("binding IS NOT NULL").select("domain", "binding", F.col("container").alias("_own"))
    whole = containers.where("binding IS NULL").select("domain", F.col("container").alias("_whole"))
    out = points.join(own, ["domain", "binding"], "left").join(whole, "domain", "left")
    return out.withColumn("container", F.coalesce("_own", "_whole")).drop("_own", "_whole")


def key_changes(declared: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """(by, change): keys declared that no point has are new, those whose point is retired revived; living points no more declared retired.

    held: (by, retired), a row a key.
    """
    both = declared.select(*by, F.lit(True).alias("_d")).join(held.select(*by, "retired"), by, "full")
    change = F.when(F.col("_d") & F.col("retired").isNull(), "new").when(F.col("_d") & F.col("retired"), "revived").when(F.col("_d").isNull() & ~F.col("retired"), "retired")
    return both.withColumn("change", change).where("change IS NOT NULL").drop("_d", "retired")


def with_display_name(findings: DataFrame, outputs: DataFrame) -> DataFrame:
    """findings (key) with the display name that outputs (key, display) declare, the key itself where none does."""
    return findings.join(outputs.select("key", "display"), "key", "left").withColumn("display", F.coalesce("display", "key"))


def bindable_fields(points: DataFrame, structs: DataFrame, fields: DataFrame) -> DataFrame:
    """(tag_id, struct_id, version, number, name, bindable): fields of the struct that a point carries now, the last of structs (tag_id, t, ...), of equal
    times the largest.

    Numbers of one value can be bound, arrays and texts cannot.
    """
    carried = F.struct("struct_id", "version")
    now = structs.groupBy("tag_id").agg(F.max_by(carried, F.struct("t", carried)).alias("s"))
    out = points.select("tag_id").join(now, "tag_id").select("tag_id", "s.struct_id", "s.version").join(fields, ["struct_id", "version"])
    return out.select("tag_id", "struct_id", "version", "number", "name", (F.col("numeric") & ~F.col("is_array")).alias("bindable"))
