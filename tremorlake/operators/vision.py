"""Detections in images: boxes, suppression, counts, comparison of two detectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE, AFTER, LISTED = 30_000, 300, 100


def parse_threshold(raw: Column, default: float = 0.55) -> Column:
    """struct<value, quality>: blank is the default, a number in 0.05 to 0.95 itself, anything else incomplete."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    v = s.try_cast("double")
    ok = (v >= 0.05) & (v <= 0.95)
    value = F.when(s == "", F.lit(default)).when(ok, v)
    return F.struct(value.alias("value"), F.when(value.isNotNull(), "ok").otherwise("config_incomplete").alias("quality"))


def box_to_image(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, side: int = 640) -> Column:
    """struct<x1, y1, x2, y2> in the image, from a centre box in its letterboxed square; scaled sizes and pads are rounded half to even."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    pad = lambda n: F.floor((side - F.bround(n * scale)) / 2)
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    x = lambda d: clip((cx + d * w / 2 - pad(width)) / scale, width)
    y = lambda d: clip((cy + d * h / 2 - pad(height)) / scale, height)
    return F.struct(x(-1).alias("x1"), y(-1).alias("y1"), x(1).alias("x2"), y(1).alias("y2"))


def _begins(x: np.ndarray) -> np.ndarray:
    """Where x differs from the one before; the first always."""
    return np.append(np.ones(min(1, len(x)), bool), x[1:] != x[:-1])


def non_max_suppression(detections: DataFrame, confidence: float = 0.55, iou: float = 0.45) -> DataFrame:
    """Detections (image_id, det_id, cls, conf, x1, y1, x2, y2) that stay: confidence strictly above, and no kept one of
    the same class with a strictly larger overlap; by confidence, det_id on ties."""
    order = ["image_id", F.desc("conf"), F.asc("det_id")]
    rows = detections.where(F.col("conf") > confidence).withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(*order[1:]))).where(F.col("place") <= BEFORE)
    rows = rows.sortWithinPartitions(*order).drop("place")  # the window has dealt images to tasks, in this order

    def kept(part: pa.Table) -> pa.Table:
        """Of whole images, each by falling confidence, what stays: all classes of all images side by side, one kept of each a round."""
        image, cls = part["image_id"].to_numpy(), part["cls"].to_numpy()
        box = np.column_stack([part[c].to_numpy() for c in ("x1", "y1", "x2", "y2")])
        area = np.prod(np.maximum(box[:, 2:] - box[:, :2], 0), axis=1)
        run = np.cumsum(_begins(image)) - 1
        at = np.lexsort((cls, run))  # stable, so still by confidence in each class
        group = np.cumsum(_begins(run[at]) | _begins(cls[at])) - 1
        keep = np.zeros(len(box), bool)
        for _ in range(AFTER):
            if not len(at):
                break
            first = _begins(group)
            keep[at[first]] = True
            more = np.flatnonzero(~first)
            head, own = at[np.flatnonzero(first)[np.cumsum(first) - 1][more]], at[more]
            inter = np.prod(np.maximum(np.minimum(box[head, 2:], box[own, 2:]) - np.maximum(box[head, :2], box[own, :2]), 0), axis=1)
            union = area[head] + area[own] - inter
            apart = ~(inter > iou * np.where(union > 0, union, 1))
            at, group = own[apart], group[more][apart]
        nth = np.cumsum(keep)
        nth -= (nth - keep)[_begins(run)][run]
        return part.filter(pa.array(keep & (nth <= AFTER)))

    def whole_images(batches):
        """Batches end where an image does: the last image of a batch waits for the next one."""
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
            image = part["image_id"].to_numpy()
            cut = int(np.flatnonzero(_begins(image))[-1]) if len(image) else 0
            rest = part.slice(cut)
            if cut:
                yield from kept(part.slice(0, cut).combine_chunks()).to_batches()
        if rest is not None and rest.num_rows:
            yield from kept(rest.combine_chunks()).to_batches()

    return rows.mapInArrow(whole_images, rows.schema)


def top_detections(detections: DataFrame, k: int = LISTED) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id")
    return detections.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def helmet_counts(detections: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Per image, counts of each label over the threshold and whether a bare head or a missing vest was seen."""
    labels = ("hat", "nohat", "novest", "person", "vest")
    ok = F.col("conf") > threshold
    out = detections.groupBy("image_id").agg(*[F.count_if(ok & (F.col("label") == x)).alias(f"n_{x}") for x in labels])
    return out.withColumn("violation", (F.col("n_nohat") > 0) | (F.col("n_novest") > 0))


def detections_json(detections: DataFrame, k: int = LISTED) -> DataFrame:
    """(image_id, detections): a JSON list, the surest first."""
    item = F.struct("label", F.round("conf", 3).alias("score"), "x1", "y1", "x2", "y2")
    rows = top_detections(detections, k).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", item.alias("d")))).alias("d"))
    return rows.select("image_id", F.to_json(F.transform("d", lambda x: x["d"])).alias("detections"))


def evidence(detections: DataFrame, threshold: float, listed: int = LISTED, labels: tuple[str, ...] = ("person", "hat", "nohat", "vest", "novest")) -> DataFrame:
    """(image_id, evidence): what was found above the threshold, by label, in words; whether that breaks a rule; how many a list leaves out."""
    ok = F.col("conf") > threshold
    out = detections.groupBy("image_id").agg(F.count_if(ok).alias("n"), *[F.count_if(ok & (F.col("label") == x)).alias(f"n_{x}") for x in labels])
    each = F.concat_ws(", ", *[F.concat(F.lit(f"{x} "), F.col(f"n_{x}")) for x in labels])
    breach = F.when((F.col("n_nohat") > 0) | (F.col("n_novest") > 0), "; without helmet or vest").otherwise("; no violation")
    rest = F.when(F.col("n") > listed, F.concat(F.lit(f"; the surest {listed} of "), "n", F.lit(" listed"))).otherwise("")
    return out.select("image_id", F.concat(F.lit(f"threshold {threshold:g}: "), "n", F.lit(" found: "), each, breach, rest).alias("evidence"))


def compare_detections(a: DataFrame, b: DataFrame, box_px: float = 1.0, score: float = 0.005) -> DataFrame:
    """(image_id, na, nb, box_diff, score_diff, same): two detectors' lists by place of confidence."""
    w = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id")
    cols = ("cls", "conf", "x1", "y1", "x2", "y2")
    place = lambda d, s: d.withColumn("place", F.row_number().over(w)).select("image_id", "place", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    both = place(a, "a").join(place(b, "b"), ["image_id", "place"], "full")
    box = F.greatest(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in cols[2:]])
    out = both.groupBy("image_id").agg(
        F.count("conf_a").alias("na"), F.count("conf_b").alias("nb"), F.max(box).alias("box_diff"), F.max(F.abs(F.col("conf_a") - F.col("conf_b"))).alias("score_diff"), F.count_if(F.col("cls_a") != F.col("cls_b")).alias("cls_diff")
    )
    same = (F.col("na") == F.col("nb")) & (F.col("cls_diff") == 0) & (F.col("box_diff") <= box_px) & (F.col("score_diff") <= score)
    return out.withColumn("same", F.coalesce(same, F.lit(False)))


def explode_vision_events(events: DataFrame, threshold: float, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Detections of events (event_id, t, detections array<struct<label, score, x, y, w, h>>), boxes in shares of the image,
    at or over the threshold, centres inside the region if one is given."""
    rows = events.select("event_id", "t", F.explode("detections").alias("d")).select("event_id", "t", "d.*").where(F.col("score") >= threshold)
    if region is None:
        return rows
    x0, y0, x1, y1 = region
    return rows.where((F.col("x") + F.col("w") / 2).between(x0, x1) & (F.col("y") + F.col("h") / 2).between(y0, y1))
