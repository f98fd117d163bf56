"""Benchmark passages in documents, by winnowing, in DataFrame functions only.

Of every run of `window` - `gram` + 1 successive hashes of `gram` words the least is a fingerprint, so any
shared span of `window` words shares one. Fingerprints of documents are joined to those of the
benchmark where they arise, without a shuffle; documents that meet one are read again and their hits
extended to exact windows, whose words are hit. An item shorter than the window is one window of its own
length and is looked for whole.

The benchmark's windows, and the keys of documents to read again, are broadcast only after their number is checked
against BROADCAST_ROWS; beyond it the joins shuffle. Documents are joined by row, so a passage that many share is no hot key.

Defined results: null or wordless texts have no words and no hits; items without words are ignored; rows
of one item_id are one item; repeated rows of documents each return a row; an empty benchmark
hits nothing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z only."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BREAK, -1), "")


def _runs(hashes: str, width: int) -> Column:
    """Hash of the width words from each word on."""
    h = F.col(hashes)
    each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(F.lit(width), *[F.get(h, i + j) for j in range(width)]))
    return F.when(F.size(h) >= width, each).otherwise(F.array().cast("array<long>"))


def _least_of(values: str, width: int) -> Column:
    v = F.col(values)
    each = F.transform(F.sequence(F.lit(0), F.size(v) - width), lambda i: F.least(*[F.get(v, i + j) for j in range(width)]))
    return F.when(F.size(v) >= width, F.array_distinct(each)).otherwise(F.array().cast("array<long>"))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    rows = rows.select(*keep, words_of(F.col("text")).alias("ws"))
    return rows.select(*keep, F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"))


def _all(*parts: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 6
) -> DataFrame:
    """(id_col, n_words, n_hit, items), a row for each row of docs; items are the item_ids with occurring windows, as sorted strings."""
    span = window - gram + 1
    items = _hashed(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "item").where("size(wh) > 0")
    short = sorted(r[0] for r in items.select(F.least(F.size("wh"), F.lit(window)).alias("m")).distinct().collect() if r[0] < window)

    # the benchmark's windows and fingerprints
    whole = F.when(F.size("wh") >= window, _runs("wh", window))
    for m in short:
        whole = whole.when(F.size("wh") == m, _runs("wh", m))
    windows = items.select("item", F.explode(whole).alias("h")).groupBy("h").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    windows = written(windows, "windows")
    marks = items.where(F.size("wh") >= window).select(_runs("wh", gram).alias("g")).select(F.explode(_least_of("g", span)).alias("h"))
    for m in short:
        marks = marks.union(items.where(F.size("wh") == m).select(F.explode(_runs("wh", m)).alias("h")))
    marks = written(marks.distinct(), "marks")

    # documents that meet a fingerprint
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    met = _hashed(rows, "row", "id").select("row", "id", F.size("wh").cast("long").alias("n_words"), _runs("wh", gram).alias("g"), *[_runs("wh", m).alias(f"s{m}") for m in short])
    met = met.select("row", "id", "n_words", _all(_least_of("g", span), *[F.col(f"s{m}") for m in short]).alias("fp"))
    met = met.select("row", "id", "n_words", F.posexplode_outer("fp").alias("p", "h")).join(_small(marks.withColumn("hit", F.lit(1))), "h", "left")
    met = met.groupBy("row", "id", "n_words").agg(F.max("hit").alias("hit"), F.count(F.when(F.coalesce("p", F.lit(0)) == 0, 1)).alias("copies"))
    met = written(met, "met")

    # their hits, extended to windows
    near = rows.join(_small(met.where("hit = 1").select("row").distinct()), "row", "left_semi")
    near = _hashed(near, "row").withColumn("n", F.size("wh"))
    found = []
    for m in [*short, window]:
        at = near.where(f"n >= {m}").select("row", F.posexplode(_runs("wh", m)).alias("p", "h"))
        found.append(at.join(_small(windows), "h").select("row", "p", F.lit(m).alias("m"), "items"))
    hits = reduce(DataFrame.union, found).groupBy("row").agg(F.collect_set(F.struct("p", "m")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["p"], x["p"] + x["m"] - 1))))
    hits = hits.select("row", F.size(covered).cast("long").alias("n_hit"), F.array_sort("items").alias("items"))

    out = met.drop("hit").join(hits, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
