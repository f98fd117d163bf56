"""Queries on annotations, training sets, artifacts, points, reports, detections, documents and waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal, spectra
from ..operators import evaluation, labels, models, text, vision
from ..sources import samples as src
from ..sources import sinks
from ..sources.shared import written
from .inputs import ANNOTATIONS, DETECTIONS, SAMPLES, annotations, detections, long_waves, plain_times, samples, table, waves
from .registry import query


@query(
    f"""WITH {ANNOTATIONS}, r AS (SELECT n_nationkey AS range_id, n_nationkey AS binding, TIMESTAMP '2024-01-05' + to_days(n_nationkey) AS r_from, TIMESTAMP '2024-01-07' + to_days(n_nationkey) AS r_to FROM nation)
    SELECT range_id, count(*) AS n, min(annotation_id) AS first_id, sum(annotation_id)::BIGINT AS ids FROM r JOIN annotations a ON a.binding = r.binding AND t_to > r_from AND t_from < r_to GROUP BY range_id"""
)
def annotation_overlap(spark, d):
    start = F.lit(1704412800) + F.col("n_nationkey") * 86400
    r = table(spark, d, "nation").select(F.col("n_nationkey").alias("range_id"), F.col("n_nationkey").cast("long").alias("binding"), F.timestamp_seconds(start).alias("r_from"), F.timestamp_seconds(start + 2 * 86400).alias("r_to"))
    return labels.annotations_overlapping(annotations(spark, d), r).groupBy("range_id").agg(F.count("*").alias("n"), F.min("annotation_id").alias("first_id"), F.sum("annotation_id").alias("ids"))


@query(f"WITH {ANNOTATIONS}, n AS (SELECT binding, label, count(*) AS n FROM annotations GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY binding ORDER BY n DESC, label) AS place FROM n")
def label_counts(spark, d):
    return labels.label_counts(annotations(spark, d), ["binding"])


_DATASETS = f"""{ANNOTATIONS}, held AS (SELECT unnest([annotation_id % 4, CASE WHEN annotation_id % 3 = 0 THEN (annotation_id + 1) % 4 END]) AS dataset_id, * FROM annotations), samples AS (SELECT * FROM held WHERE dataset_id IS NOT NULL)"""


def _held(spark, d):
    """Every label in a set of its own number modulo 4, a third of them in the next set too."""
    k = F.col("annotation_id")
    sets = F.when(k % 3 == 0, F.array(k % 4, (k + 1) % 4)).otherwise(F.array(k % 4))
    return annotations(spark, d).withColumn("dataset_id", F.explode(sets))


@query(
    f"""WITH {_DATASETS}, new AS (SELECT (annotation_id + 1) % 4 AS dataset_id, annotation_id, label, data_origin FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM samples h WHERE h.dataset_id = (a.annotation_id + 1) % 4 AND h.annotation_id = a.annotation_id))
    SELECT dataset_id, label, data_origin, count(*) AS n FROM new GROUP BY ALL"""
)
def add_to_dataset(spark, d):
    out = labels.add_to_dataset(annotations(spark, d), _held(spark, d), (F.col("annotation_id") + 1) % 4)
    return out.groupBy("dataset_id", "label", "data_origin").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_DATASETS}, c AS (SELECT s.*, (s.dataset_id + 1) % 4 AS target FROM samples s WHERE NOT EXISTS (SELECT 1 FROM samples h WHERE h.annotation_id = s.annotation_id AND h.dataset_id = (s.dataset_id + 1) % 4)) SELECT label, count(*) AS n, target AS dataset_id FROM c GROUP BY label, target"""
)
def copy_samples(spark, d):
    """Each of four sets copied to the next, which holds a third of its labels already."""
    held = written(_held(spark, d), "held")
    copies = [labels.copy_samples(held, k, (k + 1) % 4) for k in range(4)]
    out = copies[0].union(copies[1]).union(copies[2]).union(copies[3])
    return out.groupBy("label", F.col("dataset_id").cast("long").alias("dataset_id")).agg(F.count("*").alias("n"))


@query(f"WITH {_DATASETS} SELECT dataset_id, count(*) AS n, count(CASE WHEN annotation_id % 3 <> 0 THEN 1 END) AS linked FROM samples GROUP BY dataset_id")
def unlink_deleted(spark, d):
    h = _held(spark, d)
    gone = h.where("annotation_id % 3 = 0").select("annotation_id")
    return labels.unlink_deleted(h, gone).groupBy("dataset_id").agg(F.count("*").alias("n"), F.count("annotation_id").alias("linked"))


@query(
    f"""WITH {ANNOTATIONS}, e AS (SELECT binding, label, CASE WHEN data_origin <> '' THEN data_origin WHEN binding % 3 = 0 THEN 'simulated' ELSE '' END AS origin FROM annotations)
    SELECT binding, CASE WHEN bool_or(origin = 'simulated') THEN 'simulated' WHEN count(DISTINCT origin) = 1 THEN min(origin) ELSE '' END AS origin, count(DISTINCT origin) AS origins, count(DISTINCT origin) > 1 AS mixed FROM e GROUP BY binding"""
)
def origin_fold(spark, d):
    now = F.when(F.col("binding") % 3 == 0, "simulated").otherwise("field")
    a = annotations(spark, d).withColumn("origin", labels.effective_origin(F.col("data_origin"), now))
    return labels.fold_origin(a, ["binding"]).join(labels.spread_of_origins(a, ["binding"]), "binding")


_ARTIFACTS = """b AS (SELECT DISTINCT s_nationkey % 3 AS domain, CAST(s_nationkey AS VARCHAR) AS binding FROM supplier),
a AS (SELECT p_partkey AS artifact_id, p_partkey % 3 AS domain, ['model', 'baseline'][1 + p_size % 2] AS kind, CASE WHEN p_partkey % 40 < 25 THEN CAST(p_partkey % 40 AS VARCHAR) WHEN p_partkey < 200 THEN '' ELSE 'x' || p_partkey END AS binding FROM part),
act AS (SELECT *, row_number() OVER (PARTITION BY domain, kind, binding ORDER BY artifact_id DESC) = 1 AS active FROM a)"""


@query(
    f"""WITH {_ARTIFACTS}, k AS (SELECT DISTINCT domain, kind FROM a)
    SELECT b.domain, b.binding, k.kind, coalesce(o.artifact_id, w.artifact_id) AS artifact_id FROM b JOIN k USING (domain) LEFT JOIN (SELECT * FROM act WHERE active AND binding <> '') o ON o.domain = b.domain AND o.kind = k.kind AND o.binding = b.binding
    LEFT JOIN (SELECT * FROM act WHERE active AND binding = '') w ON w.domain = b.domain AND w.kind = k.kind"""
)
def active_artifact(spark, d):
    from pyspark.sql import Window

    b = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("long").alias("domain"), F.col("s_nationkey").cast("string").alias("binding")).distinct()
    k = F.col("p_partkey")
    scope = F.when(k % 40 < 25, (k % 40).cast("string")).when(k < 200, "").otherwise(F.concat(F.lit("x"), k))
    a = table(spark, d, "part").select(k.alias("artifact_id"), (k % 3).alias("domain"), F.when(F.col("p_size") % 2 == 0, "model").otherwise("baseline").alias("kind"), scope.alias("binding"))
    a = a.withColumn("active", F.row_number().over(Window.partitionBy("domain", "kind", "binding").orderBy(F.desc("artifact_id"))) == 1)
    return labels.active_artifact(b, a).select("domain", "binding", "kind", "artifact_id")


@query(
    f"""WITH {SAMPLES}, p AS (SELECT DISTINCT tag_id FROM samples), r AS (SELECT tag_id, max(t) AS t, arg_max(value, t) AS value FROM samples WHERE t <= TIMESTAMP '2024-01-20' AND t > TIMESTAMP '2024-01-19' GROUP BY tag_id) SELECT p.tag_id, t, value FROM p LEFT JOIN r USING (tag_id)"""
)
def latest_struct(spark, d):
    s = samples(spark, d)
    return plain_times(labels.latest_struct(s, s, F.lit("2024-01-20").cast("timestamp"), 1))


@query(f"WITH {SAMPLES} SELECT tag_id, max(t) AS last_t, 'absent from snapshot' AS reason FROM samples WHERE tag_id % 7 = 0 GROUP BY tag_id")
def pending_deletion(spark, d):
    s = samples(spark, d)
    return plain_times(labels.pending_deletion(s.select("tag_id"), s.where("tag_id % 7 <> 0").select("tag_id").distinct(), s))


@query("SELECT l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_suppkey + 1000000 END AS tag_id, count(*) AS n FROM lineitem GROUP BY ALL")
def global_ids(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_suppkey").alias("local_id"))
    ids = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("local_id"), (F.col("s_suppkey") + 1000000).alias("tag_id"))
    return src.to_global_ids(li, ids).groupBy("position", "tag_id").agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT DISTINCT o_custkey AS binding FROM orders), new AS (SELECT binding FROM b WHERE binding % 3 <> 0), held AS (SELECT binding, binding + 5 AS point_id FROM b WHERE binding % 3 = 0)
    SELECT (SELECT count(*) FROM new) AS n, (SELECT count(*) FROM new) AS distinct_ids, (SELECT max(point_id) + 1 FROM held) AS lowest, (SELECT max(point_id) FROM held) + (SELECT count(*) FROM new) AS highest"""
)
def allocate_point_ids(spark, d):
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("binding")).distinct()
    held = b.where("binding % 3 = 0").withColumn("point_id", F.col("binding") + 5)
    out = sinks.allocate_point_ids(b, held, ["binding"])
    return out.agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("distinct_ids"), F.min("point_id").alias("lowest"), F.max("point_id").alias("highest"))


@query(
    """WITH b AS (SELECT c_custkey AS binding, 'd' || c_nationkey % 3 AS domain, c_acctbal > 0 AS enabled FROM customer), o(domain, key) AS (VALUES ('d0', 'status'), ('d0', 'zone'), ('d1', 'status')), p AS (SELECT c_custkey AS binding, c_custkey * 2 AS point_id FROM customer WHERE c_custkey % 4 <> 0)
    SELECT b.domain, key, enabled AND point_id IS NOT NULL AS in_use, count(*) AS n FROM b JOIN o USING (domain) LEFT JOIN p ON p.binding = b.binding AND key = 'status' GROUP BY ALL"""
)
def conclusion_points(spark, d):
    c = table(spark, d, "customer")
    b = c.select(F.col("c_custkey").alias("binding"), F.concat(F.lit("d"), F.col("c_nationkey") % 3).alias("domain"), (F.col("c_acctbal") > 0).alias("enabled"))
    o = spark.createDataFrame([("d0", "status"), ("d0", "zone"), ("d1", "status")], "domain string, key string")
    p = b.where("binding % 4 <> 0").select("domain", "binding", F.lit("status").alias("key"), (F.col("binding") * 2).alias("point_id"))
    return labels.conclusion_points(b, o, p).groupBy("domain", "key", "in_use").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT o_custkey % 10 AS job, o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY ALL) SELECT job, reason, n, sum(n) OVER (PARTITION BY job)::BIGINT AS total, row_number() OVER (PARTITION BY job ORDER BY n DESC, reason) AS place FROM n"""
)
def explain_skips(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("job"), F.col("o_orderstatus").alias("reason"))
    return labels.explain_skips(o, ["job"])


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _TABLES))
def table_stats(spark, d):
    return labels.table_stats({n: table(spark, d, n) for n in _TABLES})


@query(
    """SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS no_role, count(*) FILTER (c_custkey % 3 <> 0 AND c_acctbal < 0) AS bad_id, count(*) FILTER (c_custkey % 5 = 0) AS bad_beat FROM customer GROUP BY c_nationkey"""
)
def check_bindings(spark, d):
    c = table(spark, d, "customer")
    roles = F.when(F.col("c_custkey") % 3 != 0, F.create_map(F.lit("x_vel"), F.floor(F.abs("c_acctbal")) * F.signum("c_acctbal").cast("long") + F.when(F.col("c_acctbal") >= 0, 1).otherwise(0))).otherwise(F.create_map().cast("map<string,bigint>"))
    b = c.select("c_nationkey", "c_acctbal", roles.alias("roles"), F.lit(60).alias("window_s"), F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(60).alias("interval_s"), F.create_map(F.lit("a"), F.lit("1")).alias("params"))
    has = lambda x: F.count_if(F.array_contains("violations", x))
    return labels.check_bindings(b).groupBy("c_nationkey").agg(F.count("*").alias("n"), has("no role").alias("no_role"), has("point id not positive").alias("bad_id"), has("beat not positive").alias("bad_beat"))


@query("SELECT c_mktsegment AS binding_kind, count(*) AS n FROM customer WHERE c_custkey % 4 <> 1 GROUP BY 1")
def missing_required_roles(spark, d):
    c = table(spark, d, "customer").select(F.lit("d").alias("domain"), F.col("c_custkey").alias("binding"), "c_mktsegment")
    roles = c.where("binding % 4 = 1").select("domain", "binding", F.lit("x_vel").alias("role"))
    inputs = spark.createDataFrame([("d", "x_vel", True), ("d", "temp", False)], "domain string, role string, required boolean")
    out = labels.missing_required_roles(c, roles, inputs)
    return out.join(c.select("binding", "c_mktsegment"), "binding").groupBy(F.col("c_mktsegment").alias("binding_kind")).agg(F.count("*").alias("n"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS param, count(*) AS n FROM customer WHERE c_nationkey >= 10 GROUP BY 1")
def undeclared_params(spark, d):
    c = table(spark, d, "customer").select(F.lit("d").alias("domain"), F.col("c_custkey").alias("binding"), F.create_map(F.col("c_nationkey").cast("string"), F.lit("1")).alias("params"))
    declared = table(spark, d, "nation").where("n_nationkey < 10").select(F.lit("d").alias("domain"), F.col("n_nationkey").cast("string").alias("param"))
    return labels.undeclared_params(c, declared).groupBy("param").agg(F.count("*").alias("n"))


@query("SELECT p_brand, CASE WHEN p_partkey % 5 = 0 THEN 'duplicate' WHEN p_size % 7 = 0 THEN 'provenance missing' END AS reject, count(*) AS n FROM part GROUP BY ALL")
def import_check(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.lit("d").alias("domain"), F.lit("model").alias("kind"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"), F.when(F.col("p_size") % 7 == 0, " ").otherwise("lab").alias("origin"), F.col("p_name").alias("name"))
    return sinks.import_check(p, p.where("p_partkey % 5 = 0")).groupBy("p_brand", "reject").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT tag_id, t, CASE WHEN seq % 6 = 0 THEN NULL ELSE value END AS value, CASE WHEN status_code > 0 THEN 'ok' ELSE 'no_input' END AS quality FROM samples)
    SELECT CASE quality WHEN 'ok' THEN 1 ELSE -1002 END AS status_code, count(*) AS n, count(CASE WHEN quality = 'ok' THEN value END) AS n_values FROM f WHERE NOT (quality = 'ok' AND value IS NULL) GROUP BY 1"""
)
def findings_to_values(spark, d):
    f = samples(spark, d).select("tag_id", "t", F.when(F.col("seq") % 6 != 0, F.col("value")).alias("value"), F.when(F.col("status_code") > 0, "ok").otherwise("no_input").alias("quality"))
    return sinks.findings_to_values(f).groupBy("status_code").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


_SCORED = "scored AS (SELECT quality AS truth, toxic AS prediction FROM labels)"


def _scored(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("prediction"))


@query(f"WITH {_SCORED} SELECT truth, prediction, count(*) AS n FROM scored GROUP BY ALL")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_scored(spark, d))


@query(
    f"""WITH {_SCORED}, l AS (SELECT truth AS label FROM scored UNION SELECT prediction FROM scored), c AS (SELECT label, (SELECT count(*) FROM scored WHERE truth = label) AS support, (SELECT count(*) FROM scored WHERE prediction = label) AS predicted, (SELECT count(*) FROM scored WHERE truth = label AND prediction = label) AS hits FROM l)
    SELECT label, support, predicted, hits, round(hits / nullif(predicted, 0), 9) AS precision, round(hits / nullif(support, 0), 9) AS recall FROM c"""
)
def classification_report(spark, d):
    return evaluation.classification_report(_scored(spark, d)).select("label", "support", "predicted", "hits", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    """WITH s AS (SELECT DISTINCT o_orderpriority AS label, o_custkey AS sample_id FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s), h AS (SELECT *, r <= least(n - 1, greatest(1, floor(n * 0.25))) AS held_out FROM r)
    SELECT o_orderpriority AS label, held_out, count(*) AS n, count(DISTINCT sample_id) AS samples FROM orders JOIN h ON h.label = o_orderpriority AND h.sample_id = o_custkey GROUP BY ALL"""
)
def grouped_holdout(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("sample_id"))
    return evaluation.grouped_holdout(o).groupBy("label", "held_out").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"))


@query(f"WITH {SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY tag_id) AS k FROM samples) SELECT tag_id, count(*) FILTER (i <= floor(k * 0.7)) AS n_train, count(*) FILTER (i > floor(k * 0.7)) AS n_test FROM p GROUP BY tag_id")
def time_block_split(spark, d):
    return evaluation.time_block_split(samples(spark, d), ["tag_id"]).groupBy("tag_id").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))


@query("WITH c AS (SELECT quantile_cont(l_extendedprice, 0.7) AS cut FROM lineitem) SELECT l_returnflag, count(*) FILTER (l_extendedprice <= cut) AS n_train, count(*) FILTER (l_extendedprice > cut) AS n_test FROM lineitem CROSS JOIN c GROUP BY l_returnflag")
def speed_split(spark, d):
    out = evaluation.speed_split(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice")
    return out.groupBy("l_returnflag").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))


@query("WITH n AS (SELECT o_custkey % 10 AS part, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT part, round(max(n) / sum(n), 9) AS share FROM n GROUP BY part")
def majority_baseline(spark, d):
    o = table(spark, d, "orders").withColumn("part", F.col("o_custkey") % 10)
    return evaluation.majority_baseline(o, ["part"], "o_orderpriority").select("part", F.round("share", 9).alias("share"))


@query(
    """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_returnflag) SELECT l_returnflag, round(any_value(m), 8) AS train_mean, round(sqrt(avg((l_quantity - m) * (l_quantity - m))), 8) AS rmse, round(stddev_pop(l_quantity), 8) AS own_rmse FROM lineitem JOIN m USING (l_returnflag) WHERE l_orderkey % 4 = 0 GROUP BY l_returnflag"""
)
def constant_baseline(spark, d):
    out = evaluation.constant_baseline(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_orderkey") % 4 != 0)
    return out.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("train_mean", "rmse", "own_rmse")])


@query("WITH f AS (SELECT l_returnflag AS class, l_suppkey AS file, avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY ALL) SELECT class, count(*) AS files, round(avg(rate), 9) AS rate, round(avg(CASE WHEN rate > 0.5 THEN 1.0 ELSE 0.0 END), 9) AS over_half FROM f GROUP BY class")
def trigger_rate(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_suppkey").alias("file"), "l_quantity")
    return evaluation.trigger_rate(s, "l_quantity", 25.0).select("class", "files", F.round("rate", 9).alias("rate"), F.round("over_half", 9).alias("over_half"))


_SPEED = """s AS (SELECT l_suppkey AS case_id, l_extendedprice AS v, l_quantity AS rpm, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0),
fit AS (SELECT case_id, regr_slope(ln(v), ln(rpm)) AS b, regr_intercept(ln(v), ln(rpm)) AS a, avg(ln(v)) AS mean, count(*) AS n, max(ln(rpm)) - min(ln(rpm)) AS range FROM s WHERE label = 0 GROUP BY case_id),
r AS (SELECT s.*, n > 5 AND range > 0.05 AS detrended, ln(v) - CASE WHEN n > 5 AND range > 0.05 THEN a + b * ln(rpm) ELSE mean END AS residual FROM s JOIN fit USING (case_id))"""


def _detrended(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("rpm"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    return evaluation.speed_detrend(s, ["case_id"], "v", "rpm")


@query(f"WITH {_SPEED} SELECT case_id, bool_and(detrended) AS detrended, count(*) AS n, round(sqrt(avg(residual * residual)), 7) AS spread FROM r GROUP BY case_id")
def speed_detrend(spark, d):
    return _detrended(spark, d).groupBy("case_id").agg(F.bool_and("detrended").alias("detrended"), F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 7).alias("spread"))


@query(f"WITH {_SPEED} SELECT case_id, round(avg(CASE WHEN label > 0 THEN CASE WHEN residual >= 0.1 THEN 1.0 ELSE 0.0 END END), 9) AS hit, round(avg(CASE WHEN label = 0 THEN CASE WHEN residual >= 0.1 THEN 1.0 ELSE 0.0 END END), 9) AS false_alarm FROM r GROUP BY case_id")
def hit_and_false_alarm(spark, d):
    return evaluation.hit_and_false_alarm(_detrended(spark, d), ["case_id"], "residual", 0.1).select("case_id", F.round("hit", 9).alias("hit"), F.round("false_alarm", 9).alias("false_alarm"))


@query(f"WITH {SAMPLES}, f AS (SELECT tag_id, min(t) AS f0, max(t) AS f1 FROM samples WHERE value > 12 GROUP BY tag_id) SELECT tag_id, count(*) AS n FROM samples JOIN f USING (tag_id) WHERE value <= 12 AND t BETWEEN f0 AND f1 GROUP BY tag_id")
def same_period(spark, d):
    s = samples(spark, d)
    return evaluation.same_period(s.where("value > 12"), s.where("value <= 12"), ["tag_id"]).groupBy("tag_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SAMPLES}, a AS (SELECT *, (epoch_us(t) - min(epoch_us(t)) OVER (PARTITION BY tag_id)) / 8.64e10 AS age FROM samples), l AS (SELECT *, max(age) OVER (PARTITION BY tag_id) AS life FROM a) SELECT tag_id, round(max(life), 9) AS life_days, round(avg(age / life), 9) AS mean_used, round(avg(1 - age / life), 9) AS mean_left FROM l GROUP BY tag_id"""
)
def rul_labels(spark, d):
    out = evaluation.rul_labels(samples(spark, d), ["tag_id"])
    return out.groupBy("tag_id").agg(F.round(F.max("life_days"), 9).alias("life_days"), F.round(F.avg("consumed"), 9).alias("mean_used"), F.round(F.avg("remaining"), 9).alias("mean_left"))


@query(f"WITH {SAMPLES} SELECT tag_id, (count(*) - count(*) FILTER (seq % 3 <> 0)) * 10.0 AS remaining_s FROM samples GROUP BY tag_id HAVING count(*) FILTER (seq % 3 <> 0) > 0")
def remaining_of_truncated(spark, d):
    s = samples(spark, d)
    return evaluation.remaining_of_truncated(s, s.where("seq % 3 <> 0"), ["tag_id"])


@query("SELECT c_nationkey, round(pow(sum(pow(abs(c_acctbal) + 1, 1.5)) / count(*) FILTER (c_custkey % 3 = 0), 1 / 1.5), 5) AS eta FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (c_custkey % 3 = 0) > 0")
def weibull_eta(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", (F.abs("c_acctbal") + 1).alias("life"), (F.col("c_custkey") % 3 == 0).alias("failed"))
    return evaluation.weibull_eta(c, ["c_nationkey"], 1.5).select("c_nationkey", F.round("eta", 5).alias("eta"))


@query("SELECT l_returnflag, round(sqrt(avg(pow((1 - exp(-pow(l_quantity / 30, 2.0))) - (1 - exp(-pow((l_quantity + l_linenumber) / 30, 2.0))), 2))), 9) AS gap FROM lineitem GROUP BY l_returnflag")
def weibull_cdf_gap(spark, d):
    li = table(spark, d, "lineitem").withColumn("other", F.col("l_quantity") + F.col("l_linenumber"))
    return evaluation.weibull_cdf_gap(li, ["l_returnflag"], "l_quantity", "other", 30.0, 2.0).select("l_returnflag", F.round("gap", 9).alias("gap"))


@query(
    """WITH f AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_orderkey % 100 = 1 GROUP BY 1) SELECT l_returnflag, round(avg(least(1, greatest(0, (l_quantity - lo) / (hi - lo)))), 8) AS mean, count(*) AS n FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag"""
)
def minmax(spark, d):
    out = evaluation.minmax(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], F.col("l_orderkey") % 100 == 1)
    return out.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity_scaled"), 8).alias("mean"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 1000000 + l_suppkey AS k, [l_discount * 10, l_tax * 10, 0.5] AS v FROM lineitem), e AS (SELECT *, exp(v[1]) + exp(v[2]) + exp(v[3]) AS z, abs(v[1] + v[2] + v[3] - 1) <= 1e-3 AND v[1] >= 0 AND v[2] >= 0 AS done FROM s)
    SELECT done, count(*) AS n, round(sum(CASE WHEN done THEN v[1] ELSE exp(v[1]) / z END), 5) AS first, sum(CASE WHEN v[1] >= v[2] AND v[1] >= v[3] THEN 0 WHEN v[2] >= v[3] THEN 1 ELSE 2 END)::BIGINT AS classes FROM e GROUP BY done"""
)
def softmax_if_needed(spark, d):
    li = table(spark, d, "lineitem").withColumn("v", F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5)))
    v = F.col("v")
    done = (F.abs(v[0] + v[1] + v[2] - 1) <= 1e-3) & (v[0] >= 0) & (v[1] >= 0)
    return li.groupBy(done.alias("done")).agg(F.count("*").alias("n"), F.round(F.sum(evaluation.softmax_if_needed(v)[0]), 5).alias("first"), F.sum(evaluation.arg_max(v)).alias("classes"))


@query("SELECT CASE WHEN p_size % 5 = 0 THEN 'model_not_loaded' WHEN p_size % 3 <> p_partkey % 3 THEN 'config_incomplete' ELSE 'ok' END AS quality, count(*) AS n FROM part GROUP BY 1")
def algorithm_mismatch(spark, d):
    p = table(spark, d, "part")
    q = evaluation.algorithm_mismatch((F.col("p_partkey") % 3).cast("string"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 3).cast("string")))
    return p.groupBy(q.alias("quality")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {DETECTIONS} SELECT image_id, count(*) FILTER (conf > 0.55 AND label = 'hat') AS n_hat, count(*) FILTER (conf > 0.55 AND label = 'nohat') AS n_nohat, count(*) FILTER (conf > 0.55 AND label = 'novest') AS n_novest, count(*) FILTER (conf > 0.55 AND label = 'person') AS n_person,
    count(*) FILTER (conf > 0.55 AND label = 'vest') AS n_vest, count(*) FILTER (conf > 0.55 AND label IN ('nohat', 'novest')) > 0 AS violation FROM detections GROUP BY image_id"""
)
def helmet_counts(spark, d):
    return vision.helmet_counts(detections(spark, d))


@query("WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN CAST(p_size / 40 AS VARCHAR) ELSE '0.95' END AS raw FROM part) SELECT CASE WHEN raw = '' OR try_cast(raw AS DOUBLE) BETWEEN 0.05 AND 0.95 THEN 'ok' ELSE 'config_incomplete' END AS quality, count(*) AS n, round(sum(CASE WHEN raw = '' THEN 0.55 WHEN try_cast(raw AS DOUBLE) BETWEEN 0.05 AND 0.95 THEN try_cast(raw AS DOUBLE) END), 4) AS total FROM r GROUP BY 1")
def parse_threshold(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " ").when(k == 1, "abc").when(k == 2, (F.col("p_size") / 40).cast("string")).otherwise("0.95")
    p = table(spark, d, "part").select(vision.parse_threshold(raw).alias("x"))
    return p.groupBy("x.quality").agg(F.count("*").alias("n"), F.round(F.sum("x.value"), 4).alias("total"))


@query(f"WITH {DETECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS place FROM detections) SELECT image_id, place, det_id, round(conf, 9) AS conf FROM r WHERE place <= 3")
def top_detections(spark, d):
    return vision.top_detections(detections(spark, d), 3).select("image_id", "place", "det_id", F.round("conf", 9).alias("conf"))


@query(
    f"""WITH {DETECTIONS}, a AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS place FROM detections), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS place FROM (SELECT image_id, det_id, cls, conf - 0.001 AS conf, x1 + det_id % 3 * 0.6 AS x1, y1, x2, y2 FROM detections WHERE det_id % 13 <> 0)),
    j AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, a.conf AS ca, b.conf AS cb, a.cls AS la, b.cls AS lb, greatest(abs(a.x1 - b.x1), abs(a.y1 - b.y1), abs(a.x2 - b.x2), abs(a.y2 - b.y2)) AS box, abs(a.conf - b.conf) AS sc FROM a FULL JOIN b ON a.image_id = b.image_id AND a.place = b.place)
    SELECT image_id, count(ca) AS na, count(cb) AS nb, round(max(box), 6) AS box_diff, coalesce(count(ca) = count(cb) AND count(*) FILTER (la <> lb) = 0 AND max(box) <= 1 AND max(sc) <= 0.005, false) AS same FROM j GROUP BY image_id"""
)
def compare_detections(spark, d):
    a = detections(spark, d)
    b = a.where("det_id % 13 <> 0").withColumn("conf", F.col("conf") - 0.001).withColumn("x1", F.col("x1") + F.col("det_id") % 3 * 0.6)
    return vision.compare_detections(a, b).select("image_id", "na", "nb", F.round("box_diff", 6).alias("box_diff"), "same")


@query(
    """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity * 12 AS cx, l_extendedprice % 640 AS cy, 20.0 + l_suppkey % 50 AS w, 30.0 AS h, 768 + l_partkey % 3 * 62 AS iw, 698 - l_suppkey % 4 * 40 AS ih FROM lineitem), s AS (SELECT *, least(640.0 / iw, 640.0 / ih) AS sc FROM b),
    p AS (SELECT *, floor((640 - round_even(iw * sc, 0)) / 2) AS px, floor((640 - round_even(ih * sc, 0)) / 2) AS py FROM s)
    SELECT iw, ih, count(*) AS n, round(sum(least(greatest((cx - w / 2 - px) / sc, 0), iw)), 3) AS x1, round(sum(least(greatest((cy + h / 2 - py) / sc, 0), ih)), 3) AS y2 FROM p GROUP BY iw, ih"""
)
def box_to_image(spark, d):
    li = table(spark, d, "lineitem")
    iw, ih = 768 + F.col("l_partkey") % 3 * 62, 698 - F.col("l_suppkey") % 4 * 40
    b = vision.box_to_image(F.col("l_quantity") * 12, F.col("l_extendedprice") % 640, 20.0 + F.col("l_suppkey") % 50, F.lit(30.0), F.col("iw"), F.col("ih"))
    out = li.withColumn("iw", iw).withColumn("ih", ih).withColumn("b", b)
    return out.groupBy("iw", "ih").agg(F.count("*").alias("n"), F.round(F.sum("b.x1"), 3).alias("x1"), F.round(F.sum("b.y2"), 3).alias("y2"))


@query()
def non_max_suppression(spark, d):
    return vision.non_max_suppression(detections(spark, d).drop("label")).groupBy("image_id").agg(F.count("*").alias("kept"), F.max("conf").alias("best"))


@query(
    """WITH e AS (SELECT l_orderkey AS event_id, l_linenumber % 5 AS k, abs(l_discount) * 10 AS score, l_quantity / 60 AS x, (l_extendedprice % 100) / 120 AS y FROM lineitem) SELECT k, count(*) AS n FROM e WHERE score >= 0.5 AND x + 0.05 BETWEEN 0.2 AND 0.8 AND y + 0.05 BETWEEN 0.2 AND 0.8 GROUP BY k"""
)
def vision_events(spark, d):
    li = table(spark, d, "lineitem")
    item = F.struct((F.col("l_linenumber") % 5).alias("label"), (F.abs("l_discount") * 10).alias("score"), (F.col("l_quantity") / 60).alias("x"), (F.col("l_extendedprice") % 100 / 120).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    e = li.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_shipdate").alias("t"), F.collect_list(item).alias("detections"))
    return vision.explode_vision_events(e, 0.5, (0.2, 0.2, 0.8, 0.8)).groupBy(F.col("label").alias("k")).agg(F.count("*").alias("n"))


#: Words of the driver's invented prose, so that patterns match something.
_PROSE = {"algorithm": {"the": r"\bthe\b", "ing": r"ing\b|tion\b"}, "low_frequency": {"street": r"mail\d|555-"}}
_PROSE_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS taxonomy, '{t}' AS tag FROM documents WHERE regexp_matches(text, '(?i){p}')" for k, ps in _PROSE.items() for t, p in ps.items())


@query(_PROSE_SQL)
def tag_documents(spark, d):
    return text.tag_documents(table(spark, d, "documents"), _PROSE)


#: What the texts are about and what they look like.
_TOPICS = {
    "topic": {"licence": r"licen[cs]e|copyright", "contact": r"mail\d|555-|@", "machine": r"\bpump\b|bearing|gear", "secret": r"key|password|token"},
    "form": {"number": r"\d{4}", "loud": r"!!|\?\?", "markup": r"[*#$%&]{3}", "piped": r" \| "},
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS taxonomy, '{t}' AS tag, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i){p}') HAVING count(*) > 0" for k, ps in _TOPICS.items() for t, p in ps.items()))
def tag_counts(spark, d):
    return text.tag_counts(text.tag_documents(table(spark, d, "documents"), _TOPICS))


@query(f"WITH t AS ({_PROSE_SQL}) SELECT doc_id, count(*) FILTER (taxonomy = 'algorithm') AS na, count(*) FILTER (taxonomy = 'low_frequency') AS nb FROM t GROUP BY doc_id HAVING na > 0 AND nb > 0")
def tagged_in_both(spark, d):
    return text.in_both(text.tag_documents(table(spark, d, "documents"), _PROSE), "algorithm", "low_frequency")


_TERMS = ["licence", "license", "source", "the ", "Hz"]


@query(
    f"""WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[\n.!?。]+'))) AS sentence FROM documents)
    SELECT doc_id, sentence FROM s WHERE length(sentence) BETWEEN 26 AND 259
      AND ({" OR ".join(f"contains(translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t.lower()}')" for t in _TERMS)})"""
)
def evidence_sentences(spark, d):
    return text.evidence_sentences(table(spark, d, "documents"), _TERMS)


@query(
    """SELECT role AS category, count(*) AS n FROM conversations WHERE turn >= 1 AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') GROUP BY role"""
)
def search_logs(spark, d):
    c = table(spark, d, "conversations").select(F.col("turn").alias("level"), F.col("role").alias("category"), F.col("text").alias("message"), F.timestamp_seconds(F.col("conv_id")).alias("t"))
    return text.search_logs(c, 1, None, "THE", F.lit("1970-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def page_of_orders(spark, d):
    rows, _ = text.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 200, 100)
    return plain_times(rows)


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def page_with_total(spark, d):
    """The third page of a hundred orders, with how many there are."""
    return plain_times(text.page_with_total(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 200, 100))


@query(
    """WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS m FROM x GROUP BY vec_id), c AS (SELECT vec_id, x - m AS y FROM x JOIN m USING (vec_id))
    SELECT vec_id, round(avg(pow(y, 4)) / pow(avg(y * y), 2), 7) AS kurt, round(max(abs(y)) / sqrt(avg(y * y)), 7) AS crest FROM c GROUP BY vec_id"""
)
def kurtosis_crest(spark, d):
    w = waves(spark, d).withColumn("k", signal.kurtosis_crest(F.col("wave")))
    return w.select("vec_id", F.round("k.kurt", 7).alias("kurt"), F.round("k.crest", 7).alias("crest"))


def _signal(spark, d, names, f):
    return signal.with_features(waves(spark, d), f, names, ["fs", "fault"]).drop("wave")


def _lines_sql(window: str, gain: str) -> str:
    """Amplitudes a of the lines k of every 64-point wave at 640 Hz, by the definition of the transform."""
    return f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), x AS (SELECT vec_id, unnest(x) - list_avg(x) AS y, generate_subscripts(x, 1) - 1 AS i FROM v),
    y AS (SELECT vec_id, i, y * {window} AS y FROM x), t AS (SELECT k, i, cos(2 * pi() * k * i / 64) AS c, sin(2 * pi() * k * i / 64) AS s FROM range(33) a(k), range(64) b(i)),
    a AS (SELECT vec_id, k, 2 * sqrt(pow(sum(y * c), 2) + pow(sum(y * s), 2)) / {gain} AS a FROM y JOIN t USING (i) GROUP BY ALL)"""


@query(
    f"""WITH {_lines_sql("(0.5 - 0.5 * cos(2 * pi() * i / 63))", "31.5")}
    SELECT vec_id, round(sqrt(sum(a * a) / 3), 8) AS acc, round(sqrt(sum(pow(a * 9806.65 / (20 * pi() * k), 2)) / 3), 8) AS vel,
        round(2 * sqrt(2) * sqrt(sum(pow(a * 9806650 / pow(20 * pi() * k, 2), 2)) / 3), 8) AS disp, 10.0 * arg_max(k, a) AS freq FROM a WHERE k >= 1 GROUP BY vec_id"""
)
def sensor_scalars(spark, d):
    w = spectra.with_spectrum(waves(spark, d), hann=True)
    s = spectra.sensor_scalars(F.col("lines"), F.col("step"))
    return w.select("vec_id", *[F.round(s[c], 8).alias(c) for c in ("acc", "vel", "disp")], s["freq"].alias("freq"))


_HARMONICS = f"""WITH {_lines_sql("1", "64")}, w AS (SELECT vec_id, 60.0 + 10 * (label % 3) AS fault FROM embeddings),
    e AS (SELECT vec_id, k, a, k = 0 OR lag(a) OVER o >= a AS low_left, k = 32 OR lead(a) OVER o >= a AS low_right FROM a WINDOW o AS (PARTITION BY vec_id ORDER BY k)),
    own AS (SELECT vec_id, arg_max(k, a) AS own FROM a JOIN w USING (vec_id) WHERE abs(10 * k - fault) <= 10 GROUP BY vec_id),
    m AS (SELECT own.vec_id, h, arg_max(k, a) AS l, max(a) AS p FROM own, range(1, 7) r(h), a WHERE a.vec_id = own.vec_id AND h * own <= 32 AND abs(k - h * own) <= greatest(0.01 * h * own, 0.5) GROUP BY ALL),
    f AS (SELECT vec_id, h, l, p, max(k) FILTER (low_left AND k <= l) AS b, min(k) FILTER (low_right AND k >= l) AS u, coalesce(max(a) FILTER (k <> l AND (abs(k - l + 2) <= 2 OR abs(k - l - 2) <= 2)), 0) AS side FROM m JOIN e USING (vec_id) GROUP BY ALL),
    n AS (SELECT f.*, CASE WHEN l = 0 THEN y.a WHEN l = 32 THEN x.a ELSE (x.a + y.a) / 2 END AS floor FROM f JOIN a x ON x.vec_id = f.vec_id AND x.k = b JOIN a y ON y.vec_id = f.vec_id AND y.k = u),
    g AS (SELECT vec_id, h, p / floor AS ratio, coalesce(min(CASE WHEN NOT (p >= 3 * floor AND {{side}}) THEN h END) OVER (PARTITION BY vec_id), 7) AS ended FROM n)
    SELECT vec_id, 10.0 * own AS own_hz, count(*) FILTER (h < ended)::INTEGER AS harmonics, round(ln(1 + coalesce(sum(ratio) FILTER (h < ended), 0)), 7) AS reading FROM own JOIN g USING (vec_id) GROUP BY ALL"""


def _harmonics(spark, d, sidebands):
    w = spectra.with_spectrum(waves(spark, d).withColumn("shaft", F.lit(20.0)))
    return spectra.harmonic_reading(w, sidebands).select("vec_id", "own_hz", "harmonics", F.round("reading", 7).alias("reading"))


@query(_HARMONICS.format(side="true"))
def raw_spectrum_harmonics(spark, d):
    """Harmonics of the fault frequency over the valleys beside them in the plain spectrum of each wave."""
    return _harmonics(spark, d, False)


@query(_HARMONICS.format(side="side >= 2 * floor"))
def raw_spectrum_sidebands(spark, d):
    """The same with a sideband at the shaft frequency beside each harmonic."""
    return _harmonics(spark, d, True)


@query()
def envelope_snr(spark, d):
    return _signal(spark, d, ["snr", "white_snr"], lambda x, a: {"snr": signal.envelope_snr(x, a["fs"], a["fault"]), "white_snr": signal.envelope_snr(signal.prewhitened(x), a["fs"], a["fault"])})


@query()
def cyclic_coherence(spark, d):
    """Modulation of each wave at its fault frequency and at its double."""
    return _signal(spark, d, ["once", "twice"], lambda x, a: dict(zip(("once", "twice"), signal.cyclic_coherence(x, a["fs"], a["fault"][:, None] * [1, 2], 16).T)))


@query()
def harmonic_count(spark, d):
    def f(x, a):
        s = signal.envelope_spectrum(x, a["fs"], *signal.kurtosis_band(x, a["fs"], (8, 16)), squared=True)
        raw = signal.spectrum(x, a["fs"])
        return {
            "harmonics": signal.harmonic_count(*s, a["fault"]), "reading": signal.expert_reading(*s, a["fault"], 20.0, True), "raw_harmonics": signal.harmonic_count(*raw, a["fault"]),
            "ball": signal.rolling_element_evidence(*s, a["fault"], 8.0, [90.0, 130.0])["evident"],
        }

    return _signal(spark, d, ["harmonics", "reading", "raw_harmonics", "ball"], f)


@query()
def life_indicators(spark, d):
    return _signal(spark, d, ["vel", "acc", "kurt", "crest", "high", "env"], lambda x, a: signal.life_indicators(x, a["fs"]))


@query()
def thinning_damage(spark, d):
    out = signal.with_features(long_waves(spark, d), lambda x, a: signal.thinning_damage(x, a["fs"], 0.5), ["kept", "shift_hz", "error"], ["fs"])
    return out.drop("wave")


@query(
    f"""WITH {_lines_sql("1", "64")}, b AS (SELECT vec_id, CASE WHEN k <= 24 THEN (k - 1) // 2 ELSE k - 13 END AS b, max(a) AS a FROM a WHERE k >= 1 GROUP BY ALL)
    SELECT vec_id, {", ".join(f"round(max(a) FILTER (b = {i}), 9) AS bin{i}" for i in range(20))} FROM b GROUP BY vec_id"""
)
def spectrum_bins(spark, d):
    w = spectra.with_spectrum(waves(spark, d)).withColumn("bins", spectra.spectrum_bins(F.col("lines")))
    return w.select("vec_id", *[F.round(F.get("bins", i), 9).alias(f"bin{i}") for i in range(20)])


_PRESS = """SELECT l_orderkey, list(l_quantity ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS p, list(l_extendedprice ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS f FROM lineitem GROUP BY l_orderkey"""


def _press(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("x"))
    get = lambda c: F.transform("x", lambda r: r[c])
    v = F.when(F.col("l_orderkey") % 5 == 0, F.slice(get("l_quantity"), 1, 1)).otherwise(get("l_quantity"))
    return rows.select("l_orderkey", get("l_quantity").alias("position"), v.alias("velocity"), get("l_extendedprice").alias("force"))


@query(
    f"""WITH x AS ({_PRESS}), y AS (SELECT *, NOT (l_orderkey % 5 = 0 AND len(p) > 1) AS ok FROM x)
    SELECT l_orderkey, len(p)::INTEGER AS points, CASE WHEN ok THEN 'ok' ELSE 'input_bad' END AS quality, CASE WHEN ok THEN list_max(f) END AS peak_force, CASE WHEN ok THEN p[-1] - p[1] END AS stroke FROM y"""
)
def press_features(spark, d):
    return models.press_features(_press(spark, d)).select("l_orderkey", "points", "quality", "peak_force", "stroke")


@query(
    f"""WITH c AS ({_PRESS}), x AS (SELECT l_orderkey, len(p) AS m, list_transform(p, lambda x: x::DOUBLE) AS p, list_transform(f, lambda x: x::DOUBLE) AS f FROM c),
    ok AS (SELECT l_orderkey, m, unnest(p) AS p, unnest(f) AS f, generate_subscripts(p, 1) AS i FROM x WHERE list_max(p) > list_min(p) AND NOT (l_orderkey % 5 = 0 AND m > 1)),
    q AS (SELECT *, lead(p) OVER o AS p2, lead(f) OVER o AS f2, row_number() OVER o AS nth FROM ok WINDOW o AS (PARTITION BY l_orderkey ORDER BY p, i)),
    s AS (SELECT l_orderkey, k, min(p) + k * (max(p) - min(p)) / 15 AS pos FROM ok, range(16) r(k) GROUP BY l_orderkey, k),
    j AS (SELECT s.l_orderkey, k, pos, max_by(struct_pack(p := p, f := f, p2 := p2, f2 := f2), nth) AS z FROM s JOIN q ON s.l_orderkey = q.l_orderkey AND p <= pos GROUP BY ALL),
    y AS (SELECT l_orderkey, k, pos, CASE WHEN z.p2 IS NULL THEN z.f ELSE z.f + (z.f2 - z.f) / (z.p2 - z.p) * (pos - z.p) END AS f FROM j),
    g AS (SELECT l_orderkey, 16 AS n, {", ".join(f"round(max(f) FILTER (k = {k}), 6) AS force_{name}" for k, name in ((0, "first"), (5, "third"), (8, "middle"), (15, "last")))}, round(max(pos) FILTER (k = 8), 6) AS stroke_middle FROM y GROUP BY l_orderkey)
    SELECT l_orderkey, n, force_first, force_third, force_middle, force_last, stroke_middle FROM c LEFT JOIN g USING (l_orderkey)"""
)
def press_resample(spark, d):
    out = models.resample_press(_press(spark, d), 16)
    at = {"first": 0, "third": 5, "middle": 8, "last": 15}
    n = F.when(F.col("position_n").isNotNull(), F.size("position_n"))
    return out.select("l_orderkey", n.alias("n"), *[F.round(F.get("force_n", k), 6).alias(f"force_{c}") for c, k in at.items()], F.round(F.get("position_n", 8), 6).alias("stroke_middle"))


_FEATURES = ["vel", "acc", "kurt", "crest", "env"]


def _fault_frames(spark, d):
    f = signal.with_features(waves(spark, d), lambda x, a: signal.life_indicators(x, a["fs"]), _FEATURES, ["fs"]).drop("wave")
    return f.select("vec_id", (F.col("vec_id") % 50).alias("sample_id"), (F.col("label") % 3).cast("string").alias("label"), *_FEATURES)


@query()
def fault_classifier(spark, d):
    """Report on held-out samples of a forest trained on wave features by label."""
    usable = models.usable_frames(_fault_frames(spark, d), _FEATURES)
    return evaluation.classification_report(models.evaluate_fault_classifier(usable, _FEATURES))


@query(
    """WITH e AS (SELECT vec_id, CAST(label % 3 AS VARCHAR) AS label, vec_id % 50 AS sample FROM embeddings), m(domain, kind, binding, name, active) AS (VALUES ('vibration', 'model', '', 'all machines', false), ('vibration', 'model', '', 'three classes', true))
    SELECT domain, kind, binding, name, active, (SELECT count(DISTINCT sample) FROM e) AS sample_count, (SELECT count(*) FROM e) AS frame_count, 5 AS feature_count,
      (SELECT '{' || string_agg('"' || label || '": ' || n, ', ' ORDER BY label) || '}' FROM (SELECT label, count(*) AS n FROM e GROUP BY label)) AS label_counts, 64 AS hash_length, 'trained' AS origin FROM m"""
)
def trained_models(spark, d):
    """The registry after two models were trained, the first stored twice, and both made active in turn."""
    import uuid

    from ..sources import registry
    from ..sources.shared import shared_dir, written

    root, frames = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}", written(_fault_frames(spark, d), "frames")
    for name in ("all machines", "all machines", "three classes"):
        request = {"domain": "vibration", "kind": "model", "binding": "", "name": name, "algo": "forest", "origin": "trained", "data_origin": "field"}
        registry.activate(spark, root, registry.train_and_store(spark, root, frames, request, lambda x: models.train_fault_classifier(x, _FEATURES, trees=10)))
    out = registry.registered(spark, root).withColumn("hash_length", F.length("sha256"))
    return out.select("domain", "kind", "binding", "name", "active", "sample_count", "frame_count", "feature_count", "label_counts", "hash_length", "origin")


_STUDY = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS wave, CAST(label % 3 AS VARCHAR) AS label, vec_id % 50 AS grp FROM embeddings),
    t0 AS (SELECT vec_id, wave, label, grp, unnest(CASE label WHEN '0' THEN ['0 or 1', 'all'] WHEN '1' THEN ['0 or 1', '1 or 2', 'all'] ELSE ['1 or 2', 'all'] END) AS task FROM e),
    h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM e WHERE label = '0'),
    t AS (SELECT vec_id, wave, label, grp, task FROM t0 UNION ALL SELECT vec_id, wave, CASE WHEN i <= n // 2 THEN 'first half' ELSE 'second half' END, grp, 'null control of ' || label FROM h),
    g AS (SELECT DISTINCT task, label, grp, unnest([1, 2, 3]) AS seed FROM t), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY task, label, seed) AS n FROM g WINDOW w AS (PARTITION BY task, label, seed ORDER BY md5(seed || ':' || grp), grp)),
    s AS (SELECT vec_id, wave, t.task, t.label, seed, r > least(n - 1, greatest(1, floor(n * 0.25))) AS train FROM t JOIN r ON r.task = t.task AND r.label = t.label AND r.grp = t.grp),
    v AS (SELECT vec_id, unnest(wave) AS y FROM e), m AS (SELECT vec_id, avg(y) AS mean FROM v GROUP BY vec_id), k AS (SELECT vec_id, any_value(mean) AS mean, avg((y - mean) * (y - mean)) AS m2, avg(pow(y - mean, 4)) AS m4, max(abs(y - mean)) AS top FROM v JOIN m USING (vec_id) GROUP BY vec_id),
    x AS (SELECT task, label, seed, train, vec_id, 'scalars' AS feature_set, [mean, sqrt(m2), m4 / (m2 * m2), top / sqrt(m2)] AS x FROM s JOIN k USING (vec_id) UNION ALL SELECT task, label, seed, train, vec_id, 'values', wave FROM s),
    l AS (SELECT *, unnest(x) AS v, unnest(range(len(x))) AS i FROM x), f AS (SELECT task, feature_set, seed, label, i, avg(v) AS m, greatest(var_pop(v), 1e-9) AS s, count(*) AS n FROM l WHERE train GROUP BY ALL),
    total AS (SELECT task, feature_set, seed, sum(n) AS total FROM f WHERE i = 0 GROUP BY ALL),
    p AS (SELECT l.task, l.feature_set, l.seed, l.vec_id, l.label AS truth, f.label, sum(-0.5 * ln(2 * pi() * s) - (v - m) * (v - m) / (2 * s)) + ln(any_value(n) / any_value(total)) AS score
      FROM l JOIN f ON f.task = l.task AND f.feature_set = l.feature_set AND f.seed = l.seed AND f.i = l.i JOIN total ON total.task = l.task AND total.feature_set = l.feature_set AND total.seed = l.seed WHERE NOT train GROUP BY l.task, l.feature_set, l.seed, l.vec_id, l.label, f.label),
    b AS (SELECT task, feature_set, seed, vec_id, truth, arg_max(label, score) AS prediction FROM p GROUP BY ALL), c AS (SELECT task, feature_set, seed, truth, count(*) AS n, count(*) FILTER (truth = prediction) AS good FROM b GROUP BY ALL),
    a AS (SELECT task, feature_set, seed, sum(n) AS tested, sum(good) / sum(n) AS accuracy, max(n) / sum(n) AS chance FROM c GROUP BY ALL)"""


def _study_rows(spark, d):
    """Waves of three classes in groups: each two of them apart, all three apart, and the null control of the first."""
    from ..operators import studies

    w = waves(spark, d).select("vec_id", "wave", "fs", (F.col("label") % 3).cast("string").alias("label"), (F.col("vec_id") % 50).alias("group"))
    tasks = studies.task_rows(w, {"0 or 1": ["0", "1"], "1 or 2": ["1", "2"], "all": ["0", "1", "2"]})
    return tasks.unionByName(studies.null_control(w.where("label = '0'"), [], ["vec_id"]))


@query(
    f"WITH {_STUDY} SELECT task, feature_set, count(*) AS seeds, median(tested) AS tested, round(median(accuracy), 9) AS accuracy, round(median(chance), 9) AS chance, round(median(accuracy) - median(chance), 9) AS gain FROM a GROUP BY task, feature_set"
)
def scalars_against_values(spark, d):
    """Gaussian models on four scalars of a wave against its values, medians over three seeds, the null control beside them."""
    from ..operators import studies

    rows = studies.repeated_holdout(_study_rows(spark, d), [1, 2, 3])
    n, k = F.size("wave"), signal.kurtosis_crest(F.col("wave"))
    mean = F.aggregate("wave", F.lit(0.0), lambda a, v: a + v) / n
    deviation = F.sqrt(F.aggregate("wave", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    rows = rows.withColumn("scalars", F.array(mean, deviation, k["kurt"], k["crest"]))
    x = studies.feature_rows(rows, {"scalars": F.col("scalars"), "values": F.col("wave")}).select(*studies.KEYS, "label", "train", "x")
    out = studies.study_table(studies.gaussian_scores(x))
    return out.select("task", "feature_set", "seeds", "tested", *[F.round(c, 9).alias(c) for c in ("accuracy", "chance", "gain")])


@query()
def scalars_against_spectrum(spark, d):
    """Forests on four sensor scalars of a wave against its spectrum in 20 ranges, medians over two seeds, the null control beside them."""
    from ..operators import studies
    from ..sources.shared import written

    names, bins = ["acc", "vel", "disp", "freq"], [f"bin{i}" for i in range(20)]
    w = signal.with_features(_study_rows(spark, d), lambda x, a: signal.sensor_scalars(x, a["fs"]) | dict(zip(bins, signal.spectrum_bins(x, a["fs"]).T)), [*names, *bins], ["fs"]).drop("wave")
    rows = studies.repeated_holdout(w, [1, 2])
    x = studies.feature_rows(rows, {"scalars": F.array(*names), "spectrum": F.array(*bins)}).select(*studies.KEYS, "label", "train", "x")
    return studies.study_table(studies.forest_scores(written(x, "study"), trees=20))


@query()
def remaining_life(spark, d):
    s = evaluation.rul_labels(samples(spark, d), ["tag_id"]).withColumn("log_value", F.log1p("value"))
    return models.train_remaining_life(s, ["value", "log_value", "age_days"], "remaining", "tag_id")


@query(
    """WITH c AS (SELECT n_regionkey AS domain, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS binding, n_name AS container FROM nation WHERE n_nationkey % 3 > 0 OR n_nationkey IN (SELECT min(n_nationkey) FROM nation WHERE n_nationkey % 3 = 0 GROUP BY n_regionkey)),
    p AS (SELECT s_suppkey AS point, n_regionkey AS domain, s_nationkey AS binding FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT point, coalesce(o.container, w.container) AS container FROM p LEFT JOIN c o ON o.domain = p.domain AND o.binding = p.binding LEFT JOIN c w ON w.domain = p.domain AND w.binding IS NULL"""
)
def point_containers(spark, d):
    n = table(spark, d, "nation")
    first = n.where("n_nationkey % 3 = 0").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey")).select("n_nationkey")
    c = n.where("n_nationkey % 3 > 0").unionByName(n.join(first, "n_nationkey", "left_semi").select(n.columns))
    c = c.select(F.col("n_regionkey").alias("domain"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey")).alias("binding"), F.col("n_name").alias("container"))
    p = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("point"), F.col("n_regionkey").alias("domain"), F.col("s_nationkey").alias("binding"))
    return labels.with_containers(p, c).select("point", "container")


@query(
    """WITH d AS (SELECT DISTINCT s_nationkey AS domain, s_suppkey % 40 AS key FROM supplier WHERE s_acctbal > 0), h AS (SELECT c_nationkey AS domain, c_custkey % 40 AS key, min(c_acctbal) < 0 AS retired FROM customer GROUP BY 1, 2)
    SELECT coalesce(d.domain, h.domain) AS domain, coalesce(d.key, h.key) AS key, CASE WHEN h.key IS NULL THEN 'new' WHEN d.key IS NOT NULL THEN 'revived' ELSE 'retired' END AS change
    FROM d FULL JOIN h ON d.domain = h.domain AND d.key = h.key WHERE h.key IS NULL OR (d.key IS NOT NULL AND retired) OR (d.key IS NULL AND NOT retired)"""
)
def key_changes(spark, d):
    declared = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("domain"), (F.col("s_suppkey") % 40).alias("key")).distinct()
    held = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("domain"), (F.col("c_custkey") % 40).alias("key")).agg((F.min("c_acctbal") < 0).alias("retired"))
    return labels.key_changes(declared, held, ["domain", "key"])


@query("""SELECT o_orderpriority AS key, coalesce(n_name, o_orderpriority) AS display, count(*) AS n FROM orders LEFT JOIN nation ON n_nationkey = CAST(left(o_orderpriority, 1) AS INTEGER) AND n_nationkey < 4 GROUP BY 1, 2""")
def display_names(spark, d):
    names = table(spark, d, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("display"))
    keys = table(spark, d, "orders").select("o_orderpriority").distinct().withColumn("i", F.left("o_orderpriority", F.lit(1)).cast("int"))
    outputs = keys.join(names, "i").select(F.col("o_orderpriority").alias("key"), "display")
    out = labels.with_display_name(table(spark, d, "orders").select(F.col("o_orderpriority").alias("key")), outputs)
    return out.groupBy("key", "display").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT user_id AS tag_id, arg_max(event_id % 4, ts) AS struct_id FROM events GROUP BY user_id), f AS (SELECT p_partkey % 4 AS struct_id, p_size AS number, min(p_brand) AS name, bool_and(p_partkey % 5 > 0) AS num, bool_or(p_partkey % 7 = 0) AS arr FROM part GROUP BY 1, 2)
    SELECT struct_id, number, name, num AND NOT arr AS bindable, count(*) AS n FROM s JOIN f USING (struct_id) GROUP BY ALL"""
)
def bindable_fields(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("tag_id"), F.struct("ts", "event_id").alias("t"), (F.col("event_id") % 4).alias("struct_id"), F.lit(1).alias("version"))
    k = F.col("p_partkey")
    f = table(spark, d, "part").groupBy((k % 4).alias("struct_id"), F.col("p_size").alias("number")).agg(F.min("p_brand").alias("name"), F.every(k % 5 > 0).alias("numeric"), F.some(k % 7 == 0).alias("is_array"))
    out = labels.bindable_fields(e.select("tag_id").distinct(), e, f.withColumn("version", F.lit(1)))
    return out.groupBy("struct_id", "number", "name", "bindable").agg(F.count("*").alias("n"))
