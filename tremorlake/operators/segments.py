"""Long records in segments: cut in Spark, dealt to tasks, scored by segment and judged by record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cut_records(records: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """records (wave, more) once for each whole segment of size values: segment, its number from 0, and wave, its values.

    Segments are dealt to parts tasks, or as many as shuffles have, so that a record of any length is not one task's work. A null record
    and a rest that fills no segment give none.
    """
    n = F.floor(F.size("wave") / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("wave", i * size + 1, size))
    out = records.where(F.size("wave") >= size).select(*[c for c in records.columns if c != "wave"], F.posexplode(pieces).alias("segment", "wave"))
    return out.repartition(parts) if parts else out.repartition()


def segments_of_rows(rows: DataFrame, by: list[str], index: str, value: str, size: int) -> DataFrame:
    """(by, segment, wave) of a record that is a row a value, index from 0: no record is ever one array."""
    each = rows.withColumn("segment", F.floor(F.col(index) / size).cast("int")).groupBy(*by, "segment")
    out = each.agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("x"))
    return out.where(F.size("x") == size).select(*by, "segment", F.col("x.v").alias("wave"))


def record_verdicts(segments: DataFrame, by: list[str], triggered: Column) -> DataFrame:
    """(by, segments, share, over_half): the share of a record's segments that trigger, and whether it is over one half."""
    out = segments.groupBy(*by).agg(F.count("*").alias("segments"), F.avg(F.coalesce(triggered, F.lit(False)).cast("double")).alias("share"))
    return out.withColumn("over_half", F.col("share") > 0.5)


def class_verdicts(verdicts: DataFrame, label: str) -> DataFrame:
    """(label, records, over_half): the share of each class's records of which over one half triggers."""
    return verdicts.groupBy(label).agg(F.count("*").alias("records"), F.avg(F.col("over_half").cast("double")).alias("over_half"))
