"""Near duplicates among vectors, by a forest of random-projection trees.

Every tree splits space again and again by random directions at medians, and a vector near a split goes to
both sides. Vectors that share a leaf of any tree are compared, all of them, by cosine in double
precision. A pair counts in the first leaf it shares only, so links can be counted without writing pairs,
and a leaf passes on a spanning forest of its links.

The split points come from a bounded sample (SAMPLE_ROWS vectors by a hash of the id); every vector is indexed.
Equal vectors are one class with a weight. A leaf above BLOCK vectors, as dense groups make them, is cut
into blocks and every two blocks meet in a task of their own: no task grows with the group.

Defined results: null, empty and zero vectors, and those with null or non-finite components, link with
nothing; vectors of different sizes do not link; rows that share an id are vectors of their own whose
component is shared; rows without id count for others' n_links but have no component of their own
(component_id and kept null) unless others reach it; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, written

SAMPLE_ROWS = 20_000
TREES, LEAF, BLOCK = 5, 400, 1500
#: Half the width of the strip beside a split that goes both ways, in deviations of the projected
#: difference of two vectors at the threshold.
SPILL = 0.5
PARTIAL = "id long, links long, root long"
_PARTIAL = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(size: int, levels: int) -> np.ndarray:
    d = np.random.default_rng(size).standard_normal((size, TREES * max(1, levels)))
    return d / np.sqrt((d * d).sum(0))


def _fit(sample: np.ndarray, levels: int) -> np.ndarray:
    """Medians by tree and node of complete trees, children of node i at 2 i + 1 and 2 i + 2."""
    cut = np.zeros((TREES, (1 << levels) - 1))
    p = sample @ _directions(sample.shape[1], levels)
    for t in range(TREES):
        node = np.zeros(len(sample), np.int64)
        for level in range(levels):
            v = p[:, t * levels + level]
            order = np.lexsort((v, node))
            new = np.flatnonzero(np.diff(node[order], prepend=-1))
            size = np.diff(np.append(new, len(node)))
            cut[t, node[order][new]] = v[order][new + size // 2]
            node = 2 * node + 1 + (v >= cut[t, node])
    return cut


def _route(x: np.ndarray, cut: np.ndarray, levels: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every leaf that each row reaches; a cell is its tree, the vectors' size and the leaf."""
    p = x @ _directions(x.shape[1], levels)
    rows, cells = [], []
    for t in range(TREES):
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(levels):
            off = p[row, t * levels + level] - cut[t, node]
            low, high = off < margin, off >= -margin
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
        rows.append(row)
        cells.append((t << 56) | ((x.shape[1] & 0xFFFF) << 40) | node)
    return np.concatenate(rows), np.concatenate(cells)


def _compared(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of each vector that are first met here, and the smallest class its links here reach."""
    cell, i, j = (rows[k][0].as_py() for k in ("cell", "i", "j"))
    ids, weight, side = (rows[k].to_numpy() for k in ("id", "weight", "block"))
    vectors = rows["vector"].to_pylist()
    out = {"id": [], "links": [], "root": []}
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = _unit([vectors[k] for k in at])
        near = x @ x.T >= threshold
        if i != j:
            near &= side[at][:, None] != side[at][None, :]
        np.fill_diagonal(near, False)
        if not near.any():
            continue
        # cells of earlier trees, and earlier cells of this one, that both vectors reach
        cells = [[c for c in rows["cells"][int(k)].as_py() if c < cell] for k in at]
        names = {c: n for n, c in enumerate(sorted({c for cs in cells for c in cs}))}
        member = np.zeros((len(at), max(1, len(names))), np.float32)
        for k, cs in enumerate(cells):
            member[k, [names[c] for c in cs]] = 1
        fresh = near & (member @ member.T < 0.5)
        root = np.arange(len(at))
        while True:
            low = np.minimum(root, np.where(near, root[None, :], len(at)).min(1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        hit = near.any(1)
        out["id"] += ids[at][hit].tolist()
        out["links"] += (fresh @ weight[at])[hit].tolist()
        out["root"] += ids[at][root][hit].tolist()
    return pa.table(out, schema=_PARTIAL)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", ok).withColumn("v", F.transform("v", lambda x: x + 0.0))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), F.reverse("v"))))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = written(classes.withColumn("id", F.xxhash64("h1", "h2")), "classes")

    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).agg(F.count("*")).collect()}
    total = sum(sizes.values())
    taken = classes.select("v").orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).toPandas()["v"] if total else []
    model = {}
    for size, n in sizes.items():
        own = [np.asarray(v, np.float64).tobytes() for v in taken if len(v) == size]
        levels = max(0, int(np.ceil(np.log2(n / LEAF)))) if own else 0
        levels = min(levels, int(np.log2(max(1, len(own) // 4)))) if own else 0
        model[size] = (levels, _fit(_unit(own), levels)) if levels else (0, np.zeros((TREES, 0)))
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    gap = float(np.sqrt(2 * (1 - threshold)))

    def routed(batches):
        for batch in batches:
            lists = batch.column("v").to_pylist()
            length = np.array([len(v) for v in lists])
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                raw = [np.asarray(lists[k], np.float64).tobytes() for k in at]
                levels, cut = sent.value[int(size)]
                row, cell = _route(_unit(raw), cut, levels, SPILL * gap / np.sqrt(size))
                order = np.lexsort((cell, row))
                row, cell = row[order], cell[order]
                off = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(cell))], ["id", "weight", "vector", "cells"])

    placed = written(classes.select("id", "weight", "v").mapInArrow(routed, "id long, weight long, vector binary, cells array<long>"), "placed")
    large = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    each = placed.withColumn("cell", F.explode("cells")).join(large, "cell", "left")
    each = each.withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    each = each.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "weight", "vector", "cells")
    found = written(each.groupBy("cell", "i", "j").applyInArrow(lambda part: _compared(part, threshold), PARTIAL), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("h1", "h2", "id", "least", "weight").join(links, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), "component_id")
    out = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )
