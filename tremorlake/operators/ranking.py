"""Positions and rank statistics of series of any length: ordered ranges with counts carried over, no window over a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import written

A_RANGE = 1_000_000


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position", a_range: int = A_RANGE) -> DataFrame:
    """rows with their place from 0 among those of equal by, in order.

    Rows are dealt to ranges of (by, order), numbered in each, and shifted by the sizes of the ranges before, so a long series is many tasks.
    """
    keys = [*by, *order]
    ranges = max(1, -(-rows.count() // a_range))
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_spot", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumn("_part", F.shiftright("_spot", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    placed = placed.join(before, "_part").withColumn("_at", F.col("_before") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*by).agg(F.min("_at").alias("_first"))
    return placed.join(first, by).withColumn(name, F.col("_at") - F.col("_first")).select(*rows.columns, name)


def quantile(rows: DataFrame, value: str, share: float, a_range: int = A_RANGE) -> float | None:
    """The exact quantile of all values, linear between the two around it; null without values.

    Values are counted, dealt to ranges and the counts of the ranges looked at; of the one or two ranges that hold the place asked for, the
    running counts name the values.
    """
    own = rows.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ranges = max(1, -(-own.count() // a_range))
    counted = own.groupBy("_v").agg(F.count("*").alias("_k"))
    placed = written(counted.repartitionByRange(ranges, "_v").withColumn("_part", F.spark_partition_id()), "counted")
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").agg(F.sum("_k")).collect()):  # a row for each range
        starts.append((part, before, before + n))
        before += n
    if not before:
        return None
    place = share * (before - 1)
    spots = [int(place), min(int(place) + 1, before - 1)]
    found = []
    for spot in spots:
        part, start, _ = next(x for x in starts if x[1] <= spot < x[2])
        upto = F.sum("_k").over(Window.partitionBy("_part").orderBy("_v")) + start
        found.append(placed.where(F.col("_part") == part).withColumn("_upto", upto).where(F.col("_upto") > spot).agg(F.min("_v")).first()[0])
    low, high = found
    return low + (high - low) * (place - spots[0]) if low != high else low


def concordance(rows: DataFrame, by: list[str], value: str, block_s: float = 86400.0) -> DataFrame:
    """(by, n, concordant, discordant, tied, tau) of values with time, without pairing rows: tau is Kendall's tau-b.

    A pair of different values differs first at one binary digit of their ranks. So a row stands once for each digit, beside those that share
    the digits above it; in order of time the zeros ahead of ones are the concordant pairs of that digit. Blocks of time count for
    themselves and carry their zeros over. Equal times are in order of seq; rows without a number are left out; a series of one row
    or of one value has no tau.
    """
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, "t", "seq", F.col(value).alias("_v"))
    told = written(own.groupBy(*by, "_v").agg(F.count("*").alias("_k")), "values")
    dense = numbered(told, by, ["_v"], "_r").drop("_k")
    digits = max(1, int(dense.agg(F.max("_r")).first()[0] or 0).bit_length())
    block = F.floor(F.unix_micros("t") / int(block_s * 1e6))
    shift = lambda x, d: F.floor(x / F.pow(F.lit(2.0), d)).cast("long")
    each = own.join(dense, [*by, "_v"]).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    each = each.select(*by, "t", "seq", "_d", shift(F.col("_r"), F.col("_d") + 1).alias("_above"), (shift(F.col("_r"), F.col("_d")) % 2).alias("_one"), block.alias("_b"))
    place = [*by, "_d", "_above"]
    ahead = F.sum(1 - F.col("_one")).over(Window.partitionBy(*place, "_b").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1))
    blocks = each.withColumn("_z", F.coalesce(ahead, F.lit(0))).groupBy(*place, "_b")
    blocks = blocks.agg(F.sum("_one").alias("_ones"), F.sum(1 - F.col("_one")).alias("_zeros"), F.sum(F.col("_one") * F.col("_z")).alias("_inside"))
    earlier = F.coalesce(F.sum("_zeros").over(Window.partitionBy(*place).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = blocks.withColumn("_c", F.col("_inside") + F.col("_ones") * earlier).groupBy(*place)
    pairs = pairs.agg(F.sum("_c").alias("_c"), (F.sum("_ones") * F.sum("_zeros")).alias("_all")).groupBy(*by).agg(F.sum("_c").alias("concordant"), (F.sum("_all") - F.sum("_c")).alias("discordant"))
    sizes = told.groupBy(*by).agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * (F.col("_k") - 1) / 2).cast("long").alias("tied"))
    out = sizes.join(pairs, by)
    total: Column = F.col("n") * (F.col("n") - 1) / 2
    tau = (F.col("concordant") - F.col("discordant")) / F.sqrt(F.nullif(total * (total - F.col("tied")), F.lit(0.0)))
    return out.select(*by, "n", "concordant", "discordant", "tied", tau.alias("tau"))
