"""Queries on reading samples and media, binding fields, scaling channels and listing detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality
from ..operators import evaluation, labels, vision
from ..sources import samples as src
from .inputs import DETECTIONS, SAMPLES, detections, plain_times, samples, table
from .registry import query


def _span():
    return F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")


@query(
    f"""WITH {SAMPLES}, ids AS (SELECT DISTINCT tag_id % 3 AS source, tag_id // 3 AS local_id, tag_id FROM samples), l AS (SELECT DISTINCT s_suppkey % 3 AS source, s_suppkey % 40 AS local_id FROM supplier)
    SELECT seq, tag_id, t, value FROM samples WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20' AND tag_id IN (SELECT tag_id FROM ids JOIN l USING (source, local_id))"""
)
def read_range_by_source(spark, d):
    s, k = samples(spark, d), F.col("s_suppkey")
    ids = s.select((F.col("tag_id") % 3).alias("source"), F.floor(F.col("tag_id") / 3).alias("local_id"), "tag_id").distinct()
    local = table(spark, d, "supplier").select((k % 3).alias("source"), (k % 40).alias("local_id"))
    return plain_times(src.read_range_by_source(s, ids, local, *_span()).select("seq", "tag_id", "t", "value"))


@query(
    f"""WITH {SAMPLES} SELECT seq, CASE seq % 5 WHEN 0 THEN value WHEN 1 THEN tag_id WHEN 2 THEN CAST(value > 5 AS INTEGER) END::DOUBLE AS number FROM samples"""
)
def unpack_values(spark, d):
    k = F.col("seq") % 5
    kind = F.when(k == 0, "double").when(k == 1, "long").when(k == 2, "bool").when(k == 3, "text")
    s = samples(spark, d).select("seq", kind.alias("v_kind"), F.col("value").alias("v_double"), F.col("tag_id").alias("v_long"), (F.col("value") > 5).alias("v_bool"))
    return s.select("seq", src.unpack_value().alias("number"))


@query(
    f"""WITH {SAMPLES}, k AS (SELECT *, seq % 7 = 0 AND seq % 11 > 0 AS is_struct, role = 'x_acc' AS want_struct FROM samples)
    SELECT seq, CASE WHEN is_struct <> want_struct OR status_code = -1000 THEN 'input_bad' ELSE 'ok' END AS quality, CASE WHEN is_struct = want_struct THEN value END AS value FROM k"""
)
def flag_shape_mismatch(spark, d):
    kind = F.when(F.col("seq") % 11 > 0, F.when(F.col("seq") % 7 == 0, "struct").otherwise("double"))
    good = F.when(quality.trusted(F.col("status_code")), "ok").otherwise("input_bad")
    s = samples(spark, d).withColumn("v_kind", kind).withColumn("role_is_struct", F.col("role") == "x_acc").withColumn("quality", good)
    return src.flag_shape_mismatch(s).select("seq", "quality", "value")


_MEDIA = """media AS (SELECT o_orderkey AS media_id, o_custkey % 25 AS tag_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(o_orderkey * 7919 % (30 * 86400) AS BIGINT)) AS start, o_orderkey % 5 * 1800 AS seconds FROM orders)"""


def _media(spark, d):
    k = F.col("o_orderkey")
    start = F.timestamp_seconds(F.lit(1704067200) + k * 7919 % (30 * 86400))
    return table(spark, d, "orders").select(k.alias("media_id"), (F.col("o_custkey") % 25).alias("tag_id"), start.alias("start"), (k % 5 * 1800).alias("seconds"))


@query(
    f"""WITH {SAMPLES}, {_MEDIA}, a AS (SELECT DISTINCT binding AS tag, t FROM samples),
    r AS (SELECT tag, t, media_id, row_number() OVER (PARTITION BY tag, t ORDER BY start DESC NULLS LAST, media_id DESC) AS k FROM a LEFT JOIN media m ON m.tag_id = a.tag AND m.start <= a.t AND (a.t < m.start + to_seconds(m.seconds) OR a.t = m.start))
    SELECT tag, t, media_id FROM r WHERE k = 1"""
)
def media_at(spark, d):
    asked = samples(spark, d).select(F.col("binding").alias("tag_id"), "t").distinct()
    return plain_times(src.media_at(_media(spark, d), asked))


@query(f"WITH {_MEDIA} SELECT media_id, start FROM media WHERE tag_id = 7 AND start >= TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-20' ORDER BY start, media_id LIMIT 20")
def list_media(spark, d):
    """The first 20 media of one tag in a time range."""
    return plain_times(src.list_media(_media(spark, d), 7, *_span(), 20).select("media_id", "start"))


_FIELD_INPUTS = [("x_vel", "mm/s", "velocity", 1), ("y_vel", "mm/s", "velocity", 1), ("temp", "C", "temperature", None)]


@query(
    f"""WITH f AS (SELECT p_partkey % 4 AS struct_id, p_size AS number, 'f' || p_size AS name, CASE WHEN min(p_partkey) % 3 = 0 THEN 'C' ELSE 'mm/s' END AS unit,
      CASE WHEN min(p_partkey) % 3 = 0 THEN 'temperature' WHEN max(p_partkey) % 5 = 0 THEN 'acceleration' ELSE 'velocity' END AS quantity, bool_and(p_partkey % 9 > 0) AS scalar FROM part GROUP BY 1, 2),
    i(role, unit, quantity, record_group) AS (VALUES ('x_vel', 'mm/s', 'velocity', 1), ('y_vel', 'mm/s', 'velocity', 1), ('temp', 'C', 'temperature', NULL)),
    r AS (SELECT s_nationkey AS binding, ['x_vel', 'y_vel', 'temp'][1 + s_suppkey % 3] AS role, s_suppkey % 8 AS tag_id, s_suppkey % 4 AS struct_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 60 END AS field_number, 'f' || (s_suppkey % 50) AS field_name FROM supplier),
    j AS (SELECT r.*, i.unit AS want_unit, i.quantity AS want_quantity, record_group, coalesce(a.name, CASE WHEN field_number IS NULL THEN b.name END) AS found,
      CASE WHEN field_number IS NULL THEN b.unit ELSE a.unit END AS unit, CASE WHEN field_number IS NULL THEN b.quantity ELSE a.quantity END AS quantity, CASE WHEN field_number IS NULL THEN b.scalar ELSE a.scalar END AS scalar,
      min(tag_id) OVER (PARTITION BY binding, record_group) < max(tag_id) OVER (PARTITION BY binding, record_group) AS spread
      FROM r JOIN i USING (role) LEFT JOIN f a ON a.struct_id = r.struct_id AND a.number = field_number LEFT JOIN f b ON b.struct_id = r.struct_id AND b.name = field_name)
    SELECT binding, role, tag_id, CASE WHEN found IS NULL THEN 'no such field' WHEN NOT scalar THEN 'not a number' WHEN unit <> want_unit THEN 'unit' WHEN quantity <> want_quantity THEN 'quantity' WHEN record_group IS NOT NULL AND spread THEN 'record on several points' END AS violation FROM j"""
)
def field_binding(spark, d):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    low = F.min(p) % 3 == 0
    kind = F.when(low, "temperature").when(F.max(p) % 5 == 0, "acceleration").otherwise("velocity")
    f = table(spark, d, "part").groupBy((p % 4).alias("struct_id"), F.col("p_size").cast("long").alias("number"))
    f = f.agg(F.when(low, "C").otherwise("mm/s").alias("unit"), kind.alias("quantity"), F.every(p % 9 > 0).alias("scalar")).withColumn("name", F.concat(F.lit("f"), "number"))
    role = F.element_at(F.array(*map(F.lit, ("x_vel", "y_vel", "temp"))), (k % 3 + 1).cast("int"))
    r = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("binding"), role.alias("role"), (k % 8).alias("tag_id"), (k % 4).alias("struct_id"), F.when(k % 2 == 0, k % 60).alias("field_number"), F.concat(F.lit("f"), k % 50).alias("field_name")
    )
    return labels.check_field_binding(r, f, spark.createDataFrame(_FIELD_INPUTS, "role string, unit string, quantity string, record_group int"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 2 HOUR END::TIMESTAMP AS captured_at FROM orders"""
)
def captured_at(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "+02:00").when(k == 2, "").otherwise("Z?"))
    return plain_times(table(spark, d, "orders").select("o_orderkey", src.iso_captured_at(text).alias("captured_at")))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 6 = 1 THEN NULL WHEN o_orderkey % 6 = 2 THEN 'capture time without zone' WHEN o_orderkey % 6 = 3 THEN 'no ISO-8601 capture time' ELSE 'capture time missing' END AS problem FROM orders"""
)
def capture_time_problems(spark, d):
    k, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(day, F.lit("z"))).when(k == 1, F.concat(F.lit(" "), day, F.lit(".5+0200"))).when(k == 2, day).when(k == 3, F.concat(day, F.lit("Z?"))).when(k == 4, " ")
    return table(spark, d, "orders").select("o_orderkey", src.capture_time_problem(text).alias("problem"))


@query(
    """WITH f AS (SELECT event_id, ts + to_minutes(event_id % 5) AS modified, CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 49 = 0 THEN 30000000 ELSE 1000 END AS length, user_id % 27 AS binding, value,
      CASE event_id % 8 WHEN 0 THEN 'capture time without zone' WHEN 1 THEN 'capture time missing' END AS problem, ts + INTERVAL 90 MINUTE AS t FROM events),
    r AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'no capture event' WHEN n_nationkey IS NULL THEN 'unknown binding' WHEN n_regionkey = 0 THEN 'binding disabled' WHEN length = 0 THEN 'empty' WHEN length > 20971520 THEN 'too large' ELSE problem END AS reject
      FROM f LEFT JOIN nation ON n_nationkey = binding WHERE modified <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events))
    SELECT 'img-' || event_id AS name, CASE WHEN event_id % 13 > 0 THEN binding END AS binding, CASE WHEN reject IS NULL THEN date_trunc('second', t) END AS t, CASE WHEN reject IS NULL THEN value * 2 END AS score, reject FROM r"""
)
def stream_image_events(spark, d):
    """Images and their capture events as two streams over the event files: late, doubled, missing and zone-less ones among them."""
    from ..streaming.images import image_events, scored_files
    from .inputs import stream_table
    from .queries_sequences import streamed

    def build(_):
        e, k = stream_table(spark, d, "events"), F.col("event_id")
        name = F.concat(F.lit("img-"), k)
        size = F.when(k % 50 == 0, 0).when(k % 49 == 0, 30_000_000).otherwise(1000)
        files = e.select(name.alias("name"), (F.col("ts") + F.make_interval(mins=(k % 5).cast("int"))).alias("modified"), size.alias("length"), F.col("value").cast("string").cast("binary").alias("content"), k)
        files = files.withColumn("copy", F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "event_id")
        text = F.date_format(F.col("ts") + F.expr("INTERVAL 210 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss")
        raw = F.when(k % 8 == 0, text).when(k % 8 > 1, F.concat(text, F.lit("+02:00")))
        told = e.where(k % 13 > 0).select(name.alias("name"), (F.col("user_id") % 27).alias("binding"), raw.alias("captured_at"), F.col("ts").alias("received"), k)
        told = told.withColumn("copy", F.explode(F.when(k % 12 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "event_id")
        bindings = table(spark, d, "nation").select(F.col("n_nationkey").alias("binding"), (F.col("n_regionkey") > 0).alias("enabled"))
        return image_events(scored_files(files, lambda x: x.withColumn("score", F.col("content").cast("string").cast("double") * 2)), told, bindings)

    last = table(spark, d, "events").agg(F.max("ts") - F.expr("INTERVAL 2 HOUR")).first()[0]
    return plain_times(streamed(spark, build).where(F.col("modified") <= F.lit(last)).select("name", "binding", "t", "score", "reject"))


_CAPTURE_CHANNELS = "l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey"


@query(
    f"""WITH l AS (SELECT *, l_orderkey % 40 AS capture FROM lineitem WHERE l_orderkey % 40 <> 7 OR l_orderkey < 200), n AS (SELECT capture, count(*) AS rows, count(*) FILTER (capture = 3 AND l_linenumber = 1) AS bad, count(*) FILTER (l_linenumber = 1) AS ones FROM l GROUP BY capture),
    r AS (SELECT capture, rows, CASE WHEN bad > 0 THEN 'not numbers: ' || bad || ' lines' WHEN capture = 9 AND ones < rows THEN 'ragged: 8 to 9 columns' WHEN capture = 5 THEN 'columns: 7' WHEN rows < 50 THEN 'short: ' || rows || ' rows' END AS reject FROM n),
    c AS (SELECT capture, unnest([1, 2, 3, 4, 5, 6]) AS channel, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in _CAPTURE_CHANNELS.split(', '))}]) AS x FROM l),
    s AS (SELECT capture, channel, avg(x) AS mean, stddev_pop(x) AS deviation, kurtosis_pop(x) + 3 AS kurt, greatest(max(x) - avg(x), avg(x) - min(x)) / stddev_pop(x) AS crest FROM c GROUP BY capture, channel)
    SELECT r.capture, rows, reject, channel, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(kurt, 6) AS kurt, round(crest, 6) AS crest FROM r LEFT JOIN s ON s.capture = r.capture AND reject IS NULL"""
)
def capture_features(spark, d):
    """Statistics of the channels of text files written from a table; some have words, a column too few, uneven lines or too few of them."""
    import uuid

    from ..sources.captures import capture_statistics, read_captures
    from ..sources.shared import shared_dir

    rows = table(spark, d, "lineitem").withColumn("capture", F.col("l_orderkey") % 40).where((F.col("capture") != 7) | (F.col("l_orderkey") < 200))
    first = F.col("l_linenumber") == 1
    fields = [F.when((F.col("capture") == 3) & first, "x").otherwise(F.col("l_linenumber").cast("string")), *[F.col(c).cast("string") for c in _CAPTURE_CHANNELS.split(", ")]]
    fields += [F.when(F.col("capture") != 5, F.col("l_orderkey").cast("string")), F.when((F.col("capture") == 9) & ~first, "1")]
    at = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    rows.select(F.concat_ws(", ", *fields).alias("value"), "capture").repartition("capture").write.partitionBy("capture").text(at)
    told = capture_statistics(read_captures(spark, at), 8, 50)
    told = told.select(F.regexp_extract("file", r"capture=(\d+)", 1).cast("long").alias("capture"), "rows", "reject", F.inline_outer("stats"))
    return told.select("capture", "rows", "reject", "channel", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "kurt", "crest")])


@query(
    f"""WITH {SAMPLES}, f AS (SELECT role, avg(v) AS m, stddev_pop(v) AS s FROM good WHERE seq % 2 = 0 GROUP BY role) SELECT seq, round(CASE WHEN s > 0 THEN (v - m) / s END, 6) AS z FROM good JOIN f USING (role)"""
)
def zscore(spark, d):
    s = samples(spark, d).withColumn("v", F.when(quality.trusted(F.col("status_code")), F.col("value")))
    return evaluation.zscore(s, ["role"], ["v"], F.col("seq") % 2 == 0).select("seq", F.round("v_z", 6).alias("z"))


@query(
    f"""WITH {DETECTIONS}, c AS (SELECT image_id, count(*) FILTER (conf > 0.55) AS n, count(*) FILTER (conf > 0.55 AND label = 'person') AS p, count(*) FILTER (conf > 0.55 AND label = 'hat') AS h, count(*) FILTER (conf > 0.55 AND label = 'nohat') AS nh, count(*) FILTER (conf > 0.55 AND label = 'vest') AS v, count(*) FILTER (conf > 0.55 AND label = 'novest') AS nv FROM detections GROUP BY image_id)
    SELECT image_id, 'threshold 0.55: ' || n || ' found: person ' || p || ', hat ' || h || ', nohat ' || nh || ', vest ' || v || ', novest ' || nv || CASE WHEN nh > 0 OR nv > 0 THEN '; without helmet or vest' ELSE '; no violation' END || CASE WHEN n > 3 THEN '; the surest 3 of ' || n || ' listed' ELSE '' END AS evidence FROM c"""
)
def detection_evidence(spark, d):
    return vision.evidence(detections(spark, d), 0.55, 3)


@query(
    f"""WITH {DETECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS place FROM detections)
    SELECT image_id, count(*) AS n, string_agg(label, ',' ORDER BY place) AS labels, round(sum(x1), 4) AS x1 FROM r WHERE place <= 3 GROUP BY image_id"""
)
def detections_json(spark, d):
    """The JSON lists of the three surest detections of each image, read again."""
    each = F.from_json("detections", "array<struct<label string, score double, x1 double>>")
    rows = vision.detections_json(detections(spark, d), 3).select("image_id", each.alias("d"))
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x["x1"])
    return rows.select("image_id", F.size("d").cast("long").alias("n"), F.array_join("d.label", ",").alias("labels"), F.round(total, 4).alias("x1"))
