"""Stages of the corpus pipeline against brute force, on rows with repeats, null ids and null texts."""

import os
import re
import tempfile

import numpy as np
import pytest

import corpus_pipeline as p

DOC = "doc_id long, text string, lang string, source string, n_chars long, key int"
WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    base = [_text(rng, n) for n in (60, 80, 100, 45, 70, 90, 3, 1, 120, 66)]
    passage, item = _text(rng, 50), _text(rng, 14)
    near = base[2].split()
    near[50] = "other"
    texts = list(enumerate(base)) + [(20, base[0]), (21, " ".join(near)), (22, None), (23, ""), (24, base[3] + " " + passage), (25, passage + " " + base[4])]
    texts += [(26, base[5][:200] + " " + item), (5, base[5]), (5, base[5]), (22, None), (None, base[8]), (None, "lonely words"), (None, "lonely words"), (None, None)]
    texts += [(30, _text(rng, 50) + " " + item), (None, _text(rng, 40) + " " + item), (31, "x y z"), (31, _text(rng, 40)), (32, passage)]
    folder = tempfile.mkdtemp(prefix="spark-pipeline-", dir="/tmp")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0) for i, t in texts], DOC)
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder


def rows_of(df):
    assert df.columns == p.COLUMNS
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def deduped_by_force(rows):
    """One row of each (id, text), of ids that are the least of their group; null ids count as larger than all."""
    key = lambda i, t: (0, i, "") if i is not None else (1, 0, t or "")
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = [key(i, t) for i, t in rows]
    while True:
        before = list(root)
        for a, (ia, ta) in enumerate(rows):
            for b, (ib, tb) in enumerate(rows):
                n = len(sets[a] & sets[b])
                if key(ia, ta) == key(ib, tb) or n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return sorted({r for r, x in zip(rows, root) if key(*r) == x}, key=str)


def cut_by_force(rows):
    seen, words = {}, [(t or "").split() for _, t in rows]
    for w in words:
        for j in range(len(w) - 34):
            seen[tuple(w[j : j + 35])] = seen.get(tuple(w[j : j + 35]), 0) + 1
    out = []
    for (i, t), w in zip(rows, words):
        gone = {x for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for x in range(j, j + 35)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone:
            out.append((i, t))
        elif left:
            out.append((i, left))
    return sorted(out, key=str)


def clean_by_force(rows, item):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(split(item)[j : j + 10]) for j in range(len(split(item)) - 9)}
    hit = {(i, None if i is not None else t) for i, t in rows for j in range(len(split(t)) - 9) if tuple(split(t)[j : j + 10]) in windows}
    return sorted([(i, t) for i, t in rows if (i, None if i is not None else t) not in hit], key=str)


def test_stages_by_force(spark, tables):
    docs, folder = tables
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("text IS NOT NULL").first().text
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = p.written(p.one_of_each_group(spark, docs, folder), "one")
    want = deduped_by_force(rows)
    assert rows_of(one) == want
    assert sum(i == 5 for i, _ in want) == 1 and (None, "lonely words") in want and sum(t == "lonely words" for _, t in want) == 1
    cut = p.written(p.cut_repeats(spark, one, folder), "cut")
    assert rows_of(cut) == cut_by_force(want) and any(i == 5 for i, _ in rows_of(cut))
    clean = p.written(p.drop_contaminated(spark, cut, folder), "clean")
    assert rows_of(clean) == clean_by_force(rows_of(cut), item) and len(rows_of(clean)) < len(rows_of(cut))
    packed = p.packed(spark, clean, folder).toPandas()
    assert packed["length"].sum() == packed.drop_duplicates(["doc_id", "doc_tokens"])["doc_tokens"].sum() or packed["doc_id"].isna().sum() > 1
    kept = rows_of(p.drop_toxic(spark, docs, folder))
    assert set(kept) <= set(rows)


def test_stages_of_empty_tables(spark, tables):
    docs, folder = tables
    for _, stage in p.STAGES[:-1]:
        assert rows_of(stage(spark, docs.limit(0), folder)) == []
    assert p.packed(spark, docs.limit(0), folder).count() == 0


def test_toxic_stage_is_the_operator(spark):
    from tremorlake.llm.toxicity import toxicity

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, labels = p.table(spark, d, "documents"), p.table(spark, d, "labels")
    want = {r.doc_id for r in toxicity(docs, labels).where("predicted = 0").collect()}
    assert {i for i, _ in rows_of(p.drop_toxic(spark, docs, d))} == want
