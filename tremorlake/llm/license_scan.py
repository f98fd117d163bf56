"""Licenses in texts, by ordered signature rules.

The words of a text, in lower case and joined by one space, are searched once for the keywords of all rules by an
Aho-Corasick automaton; only rules whose keyword occurs run their regular expression. Of detections that overlap, one goes if
its span lies within that of a detection of a smaller priority number, or of the same and a longer span, or of the same
span and an earlier rule; spans that overlap only in part both stay. Base phrases are found at every place and never
go. Rows are read and scanned where they are; nothing is shuffled.

Defined results: null and wordless texts have no words, no detections and score 0; repeated rows each return a row;
texts of any length are scanned whole; ties of detections are broken by the order of rules; an empty table gives an empty
result; null ids and other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .license_rules import BASE, Rule, rules
from .textkit import PLAIN, slices

SLICE_BYTES = 1 << 20
_MANY_BLANKS = re.compile(rb" {2,}")
DETECTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64()), ("base", pa.bool_())])


class Scanner:
    """Compiled rules with their automaton: texts to (words, detections)."""

    def __init__(self, signature_rules: list[Rule], base: dict[str, str]):
        self.rules = [Rule(f"base-{label}", label, 0, 0.6, phrase, re.escape(phrase)) for phrase, label in base.items()] + list(signature_rules)
        self.n_base = len(base)
        # a blank before and after makes spans of whole words; a look-ahead finds every place of a base phrase
        self.regex = [re.compile(f"(?<= )(?={r.regex} )" if i < self.n_base else f"(?<= )(?:{r.regex})(?= )") for i, r in enumerate(self.rules)]
        self.priority = np.array([r.priority for r in self.rules])
        by: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by.setdefault(r.keyword, []).append(i)
        self.gates = ahocorasick.Automaton()
        for keyword, own in by.items():
            self.gates.add_word(keyword, own)
        if by:
            self.gates.make_automaton()

    def words(self, text: bytes) -> str:
        """Its words with a blank before and after each; a character stands for each byte."""
        return f" {_MANY_BLANKS.sub(b' ', text.translate(PLAIN)).strip(b' ').decode('latin-1')} "

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """How many words text has; (start, end, rule) of the detections that stay, in words, in order."""
        joined = self.words(text)
        if joined == "  ":
            return 0, []
        gated = sorted({i for _, own in self.gates.iter(joined) for i in own}) if len(self.gates) else []
        found = []
        for i in gated:
            size = len(self.rules[i].keyword) if i < self.n_base else 0
            found += [(m.start(), m.end() + size, i) for m in self.regex[i].finditer(joined)]
        if not found:
            return joined.count(" ") - 1, []
        at = np.array(found, np.int64)
        blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 0x20)
        start, end = np.searchsorted(blanks, at[:, 0]) - 1, np.searchsorted(blanks, at[:, 1])
        keep = stays(start, end, at[:, 2], self.priority[at[:, 2]]) | (at[:, 2] < self.n_base)
        order = np.lexsort((at[:, 2], end, start))
        order = order[keep[order]]
        return len(blanks) - 1, list(zip(start[order].tolist(), end[order].tolist(), at[order, 2].tolist()))


def stays(start: np.ndarray, end: np.ndarray, rule: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which detections lie in the span of none that goes ahead of them. One that does is itself contained by one that stays."""
    keep = np.ones(len(start), bool)
    ahead_start, ahead_end = np.zeros(0, np.int64), np.zeros(0, np.int64)  # spans of smaller priority numbers, by start, with the furthest end up to each
    for p in np.unique(priority):
        own = np.flatnonzero(priority == p)
        own = own[np.lexsort((rule[own], -end[own], start[own]))]
        s, e = start[own], end[own]
        furthest = np.maximum.accumulate(e)
        keep[own[1:]] &= furthest[:-1] < e[1:]
        at = np.searchsorted(ahead_start, s, "right")
        keep[own] &= np.where(at > 0, np.append(ahead_end, 0)[at - 1], -1) < e
        both = np.concatenate([ahead_start, s])
        order = np.argsort(both, kind="stable")
        ahead_start, ahead_end = both[order], np.maximum.accumulate(np.concatenate([ahead_end, e])[order])
    return keep


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signature_rules: list[Rule] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """(id_col, n_words, detections, score) of each row; start and end of a detection count words from 0, score is its largest confidence."""
    own_rules, own_base = rules() if signature_rules is None else signature_rules, BASE if base is None else base

    def scanned(batches):
        scanner = Scanner(own_rules, own_base)
        names = [pa.array([getattr(r, k) for r in scanner.rules], t) for k, t in (("label", pa.string()), ("name", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64()))]
        is_base = pa.array([i < scanner.n_base for i in range(len(scanner.rules))])
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n_words, spans, cut = [], [], [0]
                for x in part.column("text").cast(pa.binary()):
                    n, found = scanner.scan(x.as_py() or b"")
                    n_words.append(n)
                    spans += found
                    cut.append(len(spans))
                at = np.array(spans, np.int64).reshape(-1, 3)
                which = pa.array(at[:, 2])
                structs = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), *[x.take(which) for x in names], is_base.take(which)], fields=list(DETECTION))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), structs)], ["id", "n_words", "detections"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = "struct<start:long,end:long,label:string,rule:string,priority:int,confidence:double,base:boolean>"
    out = rows.mapInArrow(scanned, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, detections array<{span}>")
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_words", "detections", score.alias("score"))


def base_places(detections: Column) -> Column:
    return F.transform(F.filter(detections, lambda d: d["base"]), lambda d: d["start"])


def labels_of(detections: Column, base_only: bool = False) -> Column:
    """Distinct labels, sorted, joined by commas."""
    kept = F.filter(detections, lambda d: d["base"]) if base_only else detections
    return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda d: d["label"]))), ",")
