"""The driver's tables in the shapes that the operators take, as Spark and as SQL.

samples come from events, machines from part, annotations from orders, detections from lineitem, waves from
embeddings. Times are kept in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def plain_times(df: DataFrame) -> DataFrame:
    """df with its times without a zone, as SQL has them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


#: The role that an event type stands for.
ROLE_OF = {"click": "x_vel", "view": "y_vel", "purchase": "z_vel", "signup": "temp", "error": "x_acc"}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_samples(table(spark, sf_dir, "events"))


def _as_samples(e: DataFrame) -> DataFrame:
    role = F.create_map(*[F.lit(x) for kv in ROLE_OF.items() for x in kv])[F.col("event_type")]
    code = F.when(F.col("event_id") % 17 == 0, -1000).when(F.col("event_id") % 29 == 0, 5004).otherwise(5000)
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("tag_id"), (F.col("user_id") % 25).alias("binding"), F.col("ts").alias("t"),
        (F.col("value") / 10).alias("value"), role.alias("role"), code.alias("status_code"),
    )


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples as a stream of the event files."""
    return _as_samples(stream_table(spark, sf_dir, "events"))


SAMPLES = """samples AS (SELECT event_id AS seq, user_id AS tag_id, user_id % 25 AS binding, ts AS t, value / 10 AS value,
  CASE event_type WHEN 'click' THEN 'x_vel' WHEN 'view' THEN 'y_vel' WHEN 'purchase' THEN 'z_vel' WHEN 'signup' THEN 'temp' ELSE 'x_acc' END AS role,
  CASE WHEN event_id % 17 = 0 THEN -1000 WHEN event_id % 29 = 0 THEN 5004 ELSE 5000 END AS status_code FROM events),
good AS (SELECT *, CASE WHEN status_code IN (1, 5000, 5004) THEN value END AS v, date_trunc('day', t) AS window_start FROM samples)"""

PEAKS = (
    SAMPLES
    + """,
peaks AS (SELECT binding, window_start, max(CASE WHEN role = 'x_vel' THEN v END) AS x, max(CASE WHEN role = 'y_vel' THEN v END) AS y, max(CASE WHEN role = 'z_vel' THEN v END) AS z,
  max(CASE WHEN role = 'x_acc' THEN v END) AS x_acc, avg(CASE WHEN role = 'temp' THEN v END) AS temp, count(v) AS n_good, count(*) AS n FROM good GROUP BY binding, window_start),
graded AS (SELECT *, CASE binding % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' ELSE '' END AS axial,
  CASE binding % 2 WHEN 0 THEN [10.0, 20.0, 30.0] ELSE [15.0, 30.0, 40.0] END AS limits FROM peaks),
radial AS (SELECT *, nullif(greatest(CASE WHEN axial <> 'x' THEN coalesce(x, -1) ELSE -1 END, CASE WHEN axial <> 'y' THEN coalesce(y, -1) ELSE -1 END, CASE WHEN axial <> 'z' THEN coalesce(z, -1) ELSE -1 END), -1) AS peak FROM graded),
zoned AS (SELECT *, CASE WHEN peak <= limits[1] THEN 'A' WHEN peak <= limits[2] THEN 'B' WHEN peak <= limits[3] THEN 'C' WHEN peak IS NOT NULL THEN 'D' END AS zone FROM radial)"""
)

MACHINES_SQL = """machines AS (SELECT p_partkey AS machine,
  ['EM', 'PU', 'BL', 'CO', 'GT', 'servoMotor', 'CE', 'EG', '', 'XX', 'CF', 'TE', 'other'][1 + p_partkey % 13] AS equipmentClass,
  CASE WHEN p_partkey % 5 = 0 THEN ['AC', 'CE', 'rotaryPD', 'SC', 'IN', 'DC', 'DE', 'MD', 'AC', '', '', '', ''][1 + p_partkey % 13] ELSE '' END AS equipmentType,
  ['rigid', 'flexible', '', 'rigid', 'flexible'][1 + p_partkey % 5] AS supportClass,
  ['', 'category1', 'category2'][1 + p_size % 3] AS pumpCategory,
  ['50', '400', '10', '', '0.5', '5000', 'x', '180'][1 + p_partkey % 8] AS ratedPowerKw,
  ['1480', '300', '', '20000', '100'][1 + p_size % 5] AS ratedSpeedRpm,
  ['', '160', '355', '80'][1 + p_partkey % 4] AS shaftHeightMm,
  CASE WHEN p_partkey % 11 = 0 THEN 'false' ELSE 'true' END AS vel_is_rms,
  ['', 'CE', 'EM', 'CO,EM'][1 + p_size % 4] AS driverClass, ['', '', 'AC', 'RE,AC'][1 + p_size % 4] AS driverType,
  CASE WHEN p_partkey % 3 = 0 THEN '1' WHEN p_partkey % 3 = 1 THEN '' ELSE '3' END AS limitAttention,
  CASE WHEN p_partkey % 3 = 1 THEN '' ELSE '2' END AS limitWarning, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE '4' END AS limitDanger FROM part)"""


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda by, *xs: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    return p.select(
        k.alias("machine"),
        pick(k, "EM", "PU", "BL", "CO", "GT", "servoMotor", "CE", "EG", "", "XX", "CF", "TE", "other").alias("equipmentClass"),
        F.when(k % 5 == 0, pick(k, "AC", "CE", "rotaryPD", "SC", "IN", "DC", "DE", "MD", "AC", "", "", "", "")).otherwise("").alias("equipmentType"),
        pick(k, "rigid", "flexible", "", "rigid", "flexible").alias("supportClass"),
        pick(size, "", "category1", "category2").alias("pumpCategory"),
        pick(k, "50", "400", "10", "", "0.5", "5000", "x", "180").alias("ratedPowerKw"),
        pick(size, "1480", "300", "", "20000", "100").alias("ratedSpeedRpm"),
        pick(k, "", "160", "355", "80").alias("shaftHeightMm"),
        F.when(k % 11 == 0, "false").otherwise("true").alias("vel_is_rms"),
        pick(size, "", "CE", "EM", "CO,EM").alias("driverClass"), pick(size, "", "", "AC", "RE,AC").alias("driverType"),
        F.lit("").alias("drivenClass"), F.lit("").alias("drivenType"), F.lit("").alias("pumpEnvironment"),
        pick(k, "1", "", "3").alias("limitAttention"), pick(k, "2", "", "2").alias("limitWarning"), pick(k, "4", "", "4").alias("limitDanger"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled spans; those of 2024 lie where the samples are."""
    o = table(spark, sf_dir, "orders")
    start = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.unix_seconds("o_orderdate"), F.lit(27 * 86400)))
    return o.select(
        F.col("o_orderkey").alias("annotation_id"), (F.col("o_custkey") % 25).alias("binding"), start.alias("t_from"), F.timestamp_seconds(F.unix_seconds(start) + 3 * 86400).alias("t_to"),
        F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderkey") % 3 == 0, "simulated").when(F.col("o_orderkey") % 3 == 1, "field").otherwise("").alias("data_origin"),
    )


ANNOTATIONS = """annotations AS (SELECT o_orderkey AS annotation_id, o_custkey % 25 AS binding,
  TIMESTAMP '2024-01-01' + to_seconds(CAST(epoch(o_orderdate) AS BIGINT) % (27 * 86400)) AS t_from,
  TIMESTAMP '2024-01-04' + to_seconds(CAST(epoch(o_orderdate) AS BIGINT) % (27 * 86400)) AS t_to, o_orderpriority AS label,
  CASE o_orderkey % 3 WHEN 0 THEN 'simulated' WHEN 1 THEN 'field' ELSE '' END AS data_origin FROM orders)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") * 8, F.col("l_extendedprice") % 400
    w, h = 20 + F.col("l_partkey") % 60, 30 + F.col("l_suppkey") % 50
    return li.select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("det_id"), (F.col("l_linenumber") % 5).cast("int").alias("cls"),
        F.element_at(F.array(*map(F.lit, ("hat", "nohat", "novest", "person", "vest"))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("label"),
        (0.4 + F.abs(F.col("l_discount")) * 5).alias("conf"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
    )


DETECTIONS = """detections AS (SELECT l_orderkey AS image_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS det_id, l_linenumber % 5 AS cls,
  ['hat', 'nohat', 'novest', 'person', 'vest'][1 + l_linenumber % 5] AS label, 0.4 + abs(l_discount) * 5 AS conf, l_quantity * 8 AS x1, l_extendedprice % 400 AS y1,
  l_quantity * 8 + 20 + l_partkey % 60 AS x2, l_extendedprice % 400 + 30 + l_suppkey % 50 AS y2 FROM lineitem)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-point waveforms at 640 Hz with a shaft at 20 Hz and a fault frequency by label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("wave"), F.lit(640.0).alias("fs"), (60.0 + 10 * (F.col("label") % 3)).alias("fault"))


def long_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One waveform a point and day from its samples in time order, at 1000 Hz."""
    s = samples(spark, sf_dir)
    day = s.groupBy("tag_id", F.to_date("t").alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", "seq", "value"))).alias("x"))
    return day.select("tag_id", "day", F.transform("x", lambda r: r["value"]).alias("wave"), F.lit(1000.0).alias("fs"))
