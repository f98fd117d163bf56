"""License scans, fill-in-the-middle and importance resampling against brute force."""

import collections
import functools
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tremorlake.llm import importance
from tremorlake.llm.fill_in_middle import Exceptions, check_sentinels, fill_in_middle, restored
from tremorlake.llm.importance import Runs, Table, gains_of, hashes, importance_resample
from tremorlake.llm.license_rules import BASE, Rule, rules
from tremorlake.llm.license_scan import Scanner, base_places, labels_of, license_scan
from tremorlake.llm.queries import op11_license_scans, op12_fill_in_middle, op13_importance_resampling

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: columns beside id and text that clash with names used inside
WIDE = "doc_id long, text string, id string, n long, row string, score string, detections string, output string, key string"
EXTRA = ("i", 7, "r", "s", "d", "o", "k")


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], WIDE)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# license scans

NOTICES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0 or the Apache License, Version 2.0 (the MIT License applies to examples)",
    "SPDX-License-Identifier: LGPL-2.1-or-later\nGNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files ... All rights reserved. gnu gnu general public license license",
    "cc by cc by-sa 4.0 ccby mit licenses MIT LICENSE é MIT License日 gpl v3 GPLv3 GPL-2.0-or-later gpl version 2 or any later version BSD 3-Clause license two-clause BSD license",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0, open font license 1.1; Mozilla Public License Version 2.0 mpl 2.0; eclipse public license v2.0; expat license; apache 2.0; zlib/libpng license",
    "İ MİT License ＭIT license GNU  GENERAL\tPUBLIC\x00LICENSE",
]


@functools.cache
def compiled(regex):
    return re.compile(f"(?<= )(?:{regex})(?= )")


def scanned_by_force(text, all_rules, base):
    """Every rule over the words joined by a blank, and every pair of detections compared."""
    ws = words(text)
    joined = "".join(f" {w}" for w in ws) + " "
    at = {m.start() + 1: i for i, m in enumerate(re.finditer(" ", joined))}
    found = [(i, i + len(p.split()), 0, -len(p.split()), k, x) for k, (p, x) in enumerate(base.items()) for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    for k, r in enumerate(all_rules):
        for m in compiled(r.regex).finditer(joined):
            found.append((at[m.start()], at[m.end() + 1], r.priority, at[m.start()] - at[m.end() + 1], len(base) + k, r.label))
    ahead = lambda a, b: a is not b and a[0] <= b[0] and a[1] >= b[1] and (a[2], a[3], a[4]) < (b[2], b[3], b[4])
    return len(ws), sorted((x[0], x[1], x[4], x[5]) for x in found if x[4] < len(base) or not any(ahead(y, x) for y in found))


def random_texts(n=120):
    rng = np.random.default_rng(5)
    parts = [*NOTICES, "mit", "license", "cc by", "nc", "4.0", "gnu general public license", "version 2", "or any later version", "licensed under the terms of the", "bsd", "Wörter und mehr", "the", "apache"]
    return [" ".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(n)]


def test_there_are_hundreds_of_rules_in_order():
    own = rules()
    assert len(own) > 300 and len({r.name for r in own}) == len(own)
    assert [r.priority for r in own] == sorted(r.priority for r in own)
    assert all(0 < r.confidence <= 1 and re.compile(r.regex) for r in own)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_every_match_of_a_rule_contains_its_keyword(data):
    rule = data.draw(st.sampled_from(rules()))
    text = data.draw(st.from_regex(re.compile(rule.regex.replace("[^ ]", "[a-z]"), re.ASCII), fullmatch=True))
    assert rule.keyword in text


def test_scanner_by_force():
    own = rules()
    scanner = Scanner(own, BASE)
    for text in [*NOTICES, *random_texts(), "", " ", "...", "x"]:
        n, want = scanned_by_force(text, own, BASE)
        got_n, got = scanner.scan(text.encode())
        assert (got_n, [(a, b, i, scanner.rules[i].label) for a, b, i in got]) == (n, want), text


def test_suppression_follows_priority_then_length_then_order():
    own = [Rule("a", "a", 2, 0.5, "x", "x y z"), Rule("b", "b", 1, 0.5, "y", "y z"), Rule("c", "c", 2, 0.5, "y", "y"), Rule("d", "d", 2, 0.5, "z", "z w"), Rule("e", "e", 2, 0.5, "w", "z w")]
    scanner = Scanner(own, {})
    assert [scanner.rules[i].label for _, _, i in scanner.scan(b"x Y z w")[1]] == ["a", "b", "d"]
    assert Scanner(own, {"y z y": "t"}).scan(b"y z y z y")[1][0] == (0, 3, 0)
    assert [x for x in Scanner([], {"y z y": "t"}).scan(b"y z y z y")[1]] == [(0, 3, 0), (2, 5, 0)]


def test_license_scan_of_rows(spark):
    rows = list(enumerate([*NOTICES, *random_texts(40), None, "", "\n", "word " * 40_000 + NOTICES[0]])) + [(3, NOTICES[3]), (None, NOTICES[1]), (None, None)]
    got = license_scan(table(spark, rows)).withColumn("base", labels_of(F.col("detections"), True)).withColumn("at", base_places(F.col("detections")))
    want = collections.Counter()
    own = {r.name: r for r in rules()}
    for i, t in rows:
        n, found = scanned_by_force(t, list(own.values()), BASE)
        best = max([0.6 if k < len(BASE) else list(own.values())[k - len(BASE)].confidence for _, _, k, _ in found], default=0.0)
        want[(i, n, tuple((a, b, x) for a, b, _, x in found), best, ",".join(sorted({x for *_, k, x in found if k < len(BASE)})))] += 1
    out = got.collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple((d.start, d.end, d.label) for d in r.detections), r.score, r.base) for r in out) == want
    assert license_scan(table(spark, [])).count() == 0


def test_license_query_keeps_the_base(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op11_license_scans(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ws, at, labels = words(d.text), [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            here = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
            at, labels = at + here, labels | ({label} if here else set())
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | ({""} if not labels else set()) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


# fill in the middle

ODD = ["", "a", "é", "日本語のテキスト", "😀x😀", "plain ascii text of some length", "ends with <", "P> begins so", "has <P> in it", "has <M>", "<S>", "a < b > c <p> <PS>", "é" * 500 + "x" * 500 + "😀" * 300, "x<", "M>y", "\u0000\u007f\u0080߿ࠀ￿\U00010000\U0010ffff"]


def filled_by_force(key, text):
    text = text or ""
    h = sha(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (key, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate([*ODD, None] * 12)] + [(5, "same"), (5, "same"), (None, "no id é"), (None, None)]
    rows += [(1000 + i, "".join(rng.choice(list("ab <>PSM\né日😀"), rng.integers(0, 400)))) for i in range(300)] + [(9_000_000_000, "é" * 3_000_000 + "z")]
    out = fill_in_middle(table(spark, rows)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter(tuple(r)[:6] for r in out) == collections.Counter(filled_by_force(*r) for r in rows)
    of = collections.defaultdict(set)
    for i, t in rows:
        of[i].add(t or "")
    assert all(r.back in of[r.doc_id] and len(r.back) == r.n for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"} and fill_in_middle(table(spark, [])).count() == 0


def test_other_sentinels_and_shares(spark):
    marks = ("[prefix]", "{s}", "~m!!")
    rows = [(i, f"text {i} é" * (i % 7 + 1)) for i in range(200)]
    out = fill_in_middle(table(spark, rows), sentinels=marks, percent=100, spm_percent=50, seed=4)
    back = {r.doc_id: r.back for r in out.select("doc_id", restored(F.col("output"), F.col("form"), marks).alias("back")).collect()}
    assert back == dict(rows) and out.where("form = 'plain'").count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "a", "b"), ("abc", "b", "z")):
        with pytest.raises(ValueError):
            check_sentinels(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=30), min_size=1, max_size=8), st.data())
def test_cuts_of_code_points_are_cuts_of_bytes(texts, data):
    raw = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    index = Exceptions(np.frombuffer(raw, np.uint8), bounds)
    assert index.n.tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        c = data.draw(st.integers(0, len(t)))
        assert index.to_bytes(index.at[i : i + 1] + c)[0] == bounds[i] + len(t[:c].encode())


# importance resampling


def odd_words():
    rng = np.random.default_rng(1)
    pool = ["a", "ab", "Été", "x" * 31, "y" * 32, "z" * 40, "q" * 300, "q" * 299 + "r", "日本語テキスト", "hello", "World", "eightbyt", "12345678", "12345679"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "-", "\n", "..."]) for _ in range(rng.integers(0, 60))) for _ in range(200)]
    return [None, "", " ", *texts, "a", "b", "ab cd", "  x", "x" * 100_000]


def runs_by_force(text, max_n):
    ws = words(text)
    return [" ".join(ws[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_interning_by_force(max_n):
    texts = odd_words()
    runs = Runs(pa.array(texts), max_n)
    assert runs.words.tolist() == [len(words(t)) for t in texts]
    got = collections.Counter((int(runs.text[i]), runs.bytes_of(i).decode()) for i in range(len(runs.start)))
    assert got == collections.Counter((row, x) for row, t in enumerate(texts) for x in runs_by_force(t, max_n))
    keys = hashes(runs)
    assert all(int(h) == xxhash.xxh64_intdigest(runs.bytes_of(i)) for i, h in enumerate(keys))
    want = collections.Counter(runs.bytes_of(i) for i in range(len(runs.start)))
    for k in (keys, np.zeros_like(keys), keys & np.uint64(7)):  # also where many or all hashes agree
        t = Table(runs, 97, k)
        assert {runs.bytes_of(int(t.owner[s])): (int(t.count[s]), int(t.bucket[s])) for s in t.used} == {w: (n, zlib.crc32(w) % 97) for w, n in want.items()}
        assert all(runs.bytes_of(i) == runs.bytes_of(int(t.owner[s])) for i, s in enumerate(t.slot))


def resampled_by_force(rows, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s = collections.Counter(bucket(x) for _, t in rows for x in runs_by_force(t, max_n))
    t = collections.Counter(bucket(x) for b in target for x in runs_by_force(b, max_n))
    total_s, total_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, x in rows:
        f = runs_by_force(x, max_n)
        w = sum(gain(bucket(y)) for y in f)
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append((i, len(words(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks[r].append(k + 1)
    return out, ranks


@pytest.mark.parametrize(("max_n", "percent", "a_range"), [(1, 10, 1_000_000), (2, 35, 7), (1, 100, 50)])
def test_resampling_by_force(spark, monkeypatch, max_n, percent, a_range):
    monkeypatch.setattr(importance, "A_RANGE", a_range)
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(60)] + ["É", "日"]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(1, 60)))) for i in range(250)] + list(zip(range(300, 600), odd_words()))
    rows += [(7, rows[7][1])] * 40 + [(None, rows[9][1])] * 30 + [(None, None), (None, "")]  # copies that share all there is to order by
    target = [" ".join(rng.choice(pool[:20], 40)) for _ in range(9)] + [None, ""]
    got = importance_resample(table(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), max_n=max_n, percent=percent).collect()
    out, ranks = resampled_by_force(rows, target, max_n, percent=percent)
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(out)
    have = collections.defaultdict(list)
    for r in got:
        if r["rank"] is not None:
            have[tuple(r)[:5]].append(r["rank"])
    assert {k: sorted(v) for k, v in have.items()} == dict(ranks)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance_resample(table(spark, []), none).count() == 0
    rows = [(i, f"a b c {i} " * 6) for i in range(30)]
    out, ranks = resampled_by_force(rows, [])
    got = importance_resample(table(spark, rows), none).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(out, key=str) and sum(r["rank"] is not None for r in got) == len(ranks) == 3
    assert gains_of(np.array([0, 3]), np.array([1, 0])).tolist() == [math.floor(1000 * math.log(2 * 5 / (1 * 3))), math.floor(1000 * math.log(1 * 5 / (4 * 3)))]


def test_queries_on_the_smallest_tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    out, ranks = resampled_by_force(docs, items)
    want = {(i, f, w, s, (ranks.get((i, n, f, w, s)) or [None])[0]) for i, n, f, w, s in out}
    assert {tuple(r) for r in op13_importance_resampling(spark, DATA).collect()} == want
    filled = {(i, n, form, a, m, sha(o), sha(t or "")) for (_, t), (i, n, form, a, m, o) in ((d, filled_by_force(*d)) for d in docs)}
    assert {tuple(r) for r in op12_fill_in_middle(spark, DATA).collect()} == filled
