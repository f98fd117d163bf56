"""Reading samples: ranges, source-scoped ids, one-of values, struct fields, numeric buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: The largest image, and numeric types of buffers.
IMAGE_BYTES = 20 << 20
DTYPES = ("i1", "u1", "i2", "u2", "i4", "u4", "i8", "u8", "f4", "f8")


def read_range(samples: DataFrame, points: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Samples of points (tag_id) in [begin, end); points may repeat."""
    return samples.where((F.col("t") >= begin) & (F.col("t") < end)).join(points.select("tag_id"), "tag_id", "left_semi")


def read_range_by_source(samples: DataFrame, ids: DataFrame, local: DataFrame, begin: Column, end: Column) -> DataFrame:
    """The same for the local ids of a source; ids maps (source, local_id) to tag_id."""
    return read_range(samples, local.join(ids, ["source", "local_id"]), begin, end)


def to_global_ids(local: DataFrame, ids: DataFrame) -> DataFrame:
    """local (position, local_id) with tag_id, 0 where there is none; every input row once."""
    return local.join(ids.select("local_id", "tag_id"), "local_id", "left").withColumn("tag_id", F.coalesce("tag_id", F.lit(0)))


def unpack_value() -> Column:
    """The number of a one-of value (v_kind, v_double, v_long, v_bool): null for null, empty, unset and text."""
    return (
        F.when(F.col("v_kind") == "double", F.col("v_double"))
        .when(F.col("v_kind") == "long", F.col("v_long").cast("double"))
        .when(F.col("v_kind") == "bool", F.col("v_bool").cast("int").cast("double"))
    )


def _decoded(payloads: pa.Array, kind: np.dtype) -> pa.Array:
    """Lists of numbers from buffers that are whole numbers of items, all at once."""
    sizes = pc.binary_length(payloads).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    payloads = payloads.cast(pa.large_binary())
    ends = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
    body = payloads.buffers()[2] if ends[-1] > ends[0] else b""
    values = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]].view(kind).astype(float)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(values))


def decode_structs(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Numeric buffers (struct_id, version, number, payload) decoded by fields (struct_id, version, number, dtype, big_endian).

    values is null for an unknown field, an unknown type or a buffer that is no whole number of items. The buffers of one type in a batch are
    decoded by one call.
    """
    known = fields.select("struct_id", "version", "number", "dtype", "big_endian")
    joined = rows.join(known, ["struct_id", "version", "number"], "left")
    sizes = {k: np.dtype(k).itemsize for k in DTYPES}

    def decoded(batches):
        for batch in batches:
            payload = batch.column("payload").cast(pa.binary())
            length = pc.fill_null(pc.binary_length(payload), -1).to_numpy(zero_copy_only=False)
            kind = np.array(batch.column("dtype").to_pylist(), object)
            big = np.array([bool(x) for x in batch.column("big_endian").to_pylist()], bool)
            parts, order = [], []
            for k, order_of in ((k, e) for k in DTYPES for e in (False, True)):
                at = np.flatnonzero((kind == k) & (big == order_of) & (length >= 0) & (length % sizes[k] == 0))
                if len(at):
                    parts.append(_decoded(payload.take(pa.array(at)), np.dtype((">" if order_of else "<") + k)))
                    order.append(at)
            place = np.full(batch.num_rows, -1, np.int64)
            if order:
                place[np.concatenate(order)] = np.arange(sum(map(len, order)))
                values = pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))
            else:
                values = pa.nulls(batch.num_rows, pa.large_list(pa.float64()))
            yield batch.append_column("values", values.cast(pa.list_(pa.float64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.mapInArrow(decoded, schema + ", values array<double>")


def project_struct_fields(values: DataFrame, roles: DataFrame, fields: DataFrame) -> DataFrame:
    """One sample for each struct value and role bound to one of its fields.

    values: (tag_id, t, struct_id, version, numbers map<int, double>); roles: (binding, role, tag_id, field_number,
    field_name). A number wins over a name; a missing or unusable field stays as a bad row.
    """
    each = values.join(roles, "tag_id")
    named = fields.select("struct_id", "version", F.col("number").alias("by_name"), F.col("name").alias("field_name"))
    each = each.join(named, ["struct_id", "version", "field_name"], "left")
    v = F.try_element_at("numbers", F.coalesce("field_number", "by_name"))
    v = F.when(~F.isnan(v), v)
    return each.select("binding", "role", "tag_id", "t", v.alias("value"), F.when(v.isNull(), "input_bad").otherwise("ok").alias("quality"))


def flag_shape_mismatch(rows: DataFrame) -> DataFrame:
    """Rows (v_kind, role_is_struct) where one is a struct and the other is not become bad, with a null value; a null kind is no struct."""
    wrong = F.coalesce(F.col("v_kind") == "struct", F.lit(False)) != F.col("role_is_struct")
    return rows.withColumn("quality", F.when(wrong, "input_bad").otherwise(F.col("quality"))).withColumn("value", F.when(~wrong, F.col("value")))


def split_outage_markers(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values, and the bad rows beside a good one at the same point and time, which mark the edge of an outage."""
    from pyspark.sql import Window

    from ..functions.quality import trusted

    w = Window.partitionBy("tag_id", "t")
    ranked = samples.withColumn("good", trusted(F.col("status_code"))).withColumn("any_good", F.max("good").over(w))
    edge = ~F.col("good") & F.col("any_good")
    return ranked.where(~edge).drop("good", "any_good"), ranked.where(edge).drop("good", "any_good")


_WAVE = ("h", "m", "s", "us", "acc_h", "acc_v")


def _wave_lines(spark, paths, width: int) -> DataFrame:
    """(file, seq, a, b, na, nb): the numbers of each line by comma and by semicolon, and whether they are as many as width."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(paths).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), place.alias("seq"), "value")
    numbers = lambda sep: F.transform(F.split("value", sep), lambda x: F.trim(x).try_cast("double"))
    enough = lambda a: (F.size(F.filter(a, lambda x: x.isNotNull())) >= width).cast("int")
    return lines.withColumn("a", numbers(",")).withColumn("b", numbers(";")).withColumn("na", enough(F.col("a"))).withColumn("nb", enough(F.col("b")))


def wave_files(spark, paths, width: int = 6, least_rows: int = 0) -> DataFrame:
    """(file, separator, rows, bad_lines, skipped): a file's separator is that by which more of its lines have numbers enough, the comma on ties.

    skipped: it has less than least_rows such lines.
    """
    out = _wave_lines(spark, paths, width).groupBy("file").agg(F.sum("na").alias("a"), F.sum("nb").alias("b"), F.count("*").alias("n"))
    rows = F.greatest("a", "b")
    return out.select("file", F.when(F.col("a") >= F.col("b"), ",").otherwise(";").alias("separator"), rows.alias("rows"), (F.col("n") - rows).alias("bad_lines"), (rows < least_rows).alias("skipped"))


def read_wave_csv(spark, paths, width: int = 6, least_rows: int = 0) -> DataFrame:
    """(file, seq, h, m, s, us, acc_h, acc_v) of text files split by comma or semicolon, one for each file; seq orders the lines of a file.

    Numbers may be written as 1.6562e+005; lines of too few numbers, and files of less than least_rows others, are left out.
    """
    kept = wave_files(spark, paths, width, least_rows).where("NOT skipped").select("file", "separator")
    lines = _wave_lines(spark, paths, width).join(kept, "file")
    v, good = F.when(F.col("separator") == ",", F.col("a")).otherwise(F.col("b")), F.when(F.col("separator") == ",", F.col("na")).otherwise(F.col("nb"))
    return lines.where(good == 1).withColumn("v", v).select("file", "seq", *[F.get("v", i).alias(n) for i, n in enumerate(_WAVE)])


def read_images(spark, path: str, captured: DataFrame, limit: int = IMAGE_BYTES) -> DataFrame:
    """Image files with captured (path, captured_at text) and a reject reason, null if usable; content is read of usable ones only.

    What is known without content decides first; the rest filters on length, which the reader of files takes over. Spark lists no files
    without content, so a captured path that has no file counts as empty.
    """
    at = F.col("captured_at")
    reason = F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty").when(F.col("length") > limit, "too large").otherwise(capture_time_problem(at))
    files = lambda: spark.read.format("binaryFile").load(path)
    known = files().drop("content").join(captured, "path", "full").withColumn("t", iso_captured_at(at)).withColumn("reject", reason)
    usable = files().where((F.col("length") > 0) & (F.col("length") <= limit)).join(captured.where(capture_time_problem(at).isNull()), "path").withColumn("t", iso_captured_at(at))
    names = ["path", "modificationTime", "length", *[c for c in captured.columns if c != "path"], "t", "reject", "content"]
    refused = known.where("reject IS NOT NULL").withColumn("content", F.lit(None).cast("binary"))
    return refused.select(names).union(usable.withColumn("reject", F.lit(None).cast("string")).select(names))


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_ZONE = r"([Zz]|[+-]\d{2}:?\d{2})$"


def iso_captured_at(raw: Column) -> Column:
    """An ISO-8601 time with its zone, Z or an offset; null without a zone."""
    raw = F.upper(F.trim(raw))
    return F.when(raw.rlike(_ISO + _ZONE), raw.try_cast("timestamp"))


def capture_time_problem(raw: Column) -> Column:
    """Why a capture time can't be used, null if it can."""
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    bare = F.trim(raw).rlike(_ISO + "$") & F.trim(raw).try_cast("timestamp").isNotNull()
    return F.when(blank, "capture time missing").when(bare, "capture time without zone").when(iso_captured_at(raw).isNull(), "no ISO-8601 capture time")


def list_media(media: DataFrame, tag: int, begin: Column, end: Column | None, limit: int) -> DataFrame:
    """Media of a tag that begin in the range, the earliest first; without an end, the latest first; ties by media_id."""
    rows = media.where((F.col("tag_id") == tag) & (F.col("start") >= begin))
    return rows.orderBy(F.desc("start"), "media_id").limit(limit) if end is None else rows.where(F.col("start") < end).orderBy("start", "media_id").limit(limit)


def media_at(media: DataFrame, times: DataFrame) -> DataFrame:
    """The medium of a tag that covers a time: start <= t < start + seconds, or t = start if it has no length; null in a gap. The latest start wins, then the
    greatest media_id.

    Both sides meet on the hours that a medium covers, in order of time: of the media that have begun only those that no later one outlasts
    are kept, so the cost is that of the rows and not of their pairs.
    """
    hour = lambda us: F.floor(us / 3_600_000_000)
    start = F.unix_micros("start")
    until = F.greatest(start, F.coalesce(F.unix_micros(F.col("start") + F.make_interval(secs=F.col("seconds"))), start))
    spans = media.where("tag_id IS NOT NULL AND start IS NOT NULL AND media_id IS NOT NULL").select("tag_id", start.alias("us"), until.alias("until"), "media_id")
    spans = spans.select("tag_id", F.explode(F.sequence(hour(F.col("us")), hour(F.col("until")))).alias("h"), "us", "media_id", "until")
    t = F.unix_micros("t")
    asked = times.select("tag_id", hour(t).alias("h"), t.alias("us"), F.lit(None).cast(spans.schema["media_id"].dataType).alias("media_id"), F.lit(None).cast("long").alias("until"))
    rows = spans.unionByName(asked).repartition("tag_id", "h").sortWithinPartitions("tag_id", "h", "us", F.asc_nulls_last("media_id"))

    def covered(batches):
        cell, begun, told = None, [], ()
        for batch in batches:
            tags, times_, ids = [], [], []
            for tag, h, us, media_id, until in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (tag, h) != cell:
                    cell, begun, told = (tag, h), [], ()
                if media_id is not None:
                    while begun and begun[-1][1] <= until:
                        begun.pop()
                    begun.append((us, until, media_id))
                elif us != told:
                    while begun and us is not None and begun[-1][1] <= us and begun[-1][0] < us:
                        begun.pop()
                    tags.append(tag)
                    times_.append(us)
                    ids.append(begun[-1][2] if begun else None)
                    told = us
            yield pa.RecordBatch.from_arrays([pa.array(tags, batch.schema.field(0).type), pa.array(times_, pa.int64()), pa.array(ids, batch.schema.field(3).type)], ["tag", "us", "media_id"])

    tag_type, id_type = rows.schema["tag_id"].dataType.simpleString(), rows.schema["media_id"].dataType.simpleString()
    out = rows.mapInArrow(covered, f"tag {tag_type}, us long, media_id {id_type}")
    return out.select("tag", F.timestamp_micros("us").alias("t"), "media_id")
