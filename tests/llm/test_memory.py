"""Python workers live on after a task, so what they keep counts against every later stage."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tremorlake.llm import blocks, jaccard_join, packing, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


class Task:
    get = classmethod(lambda cls: cls)
    partitionId = classmethod(lambda cls: 0)


STAGES = {
    "toxicity": lambda docs: toxicity.score(docs, (np.zeros(1 << toxicity.BITS, np.float32), 0.0)),
    "jaccard": lambda docs: jaccard_join._prefixes(docs, 5, 80),
    "chunks": lambda docs: blocks.chunked(docs, "id", "text", 1 << 20, stored=True),
    "packing": lambda docs: packing.token_pieces(docs, TOKENIZER, "id"),
}


@pytest.mark.parametrize("stage", STAGES)
def test_workers_give_memory_back(spark, monkeypatch, stage):
    """Under 24 MB are kept of what 16 MB of texts take."""
    rows = []
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, *a, f=kind.mapInArrow: (rows.append(fn), f(self, fn, *a))[1])
    STAGES[stage](spark.createDataFrame([(1, "one two three four five six")], "id long, text string"))
    for module in (packing, blocks):
        monkeypatch.setattr(module, "TaskContext", Task)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])

    def batches(n):
        for _ in range(n):
            yield pa.RecordBatch.from_pydict({"id": list(range(100)), "text": [" ".join(rng.choice(words, 7000)) for _ in range(100)]})

    def run(given):
        for _ in rows[-1](given):
            pass

    run(iter([pa.RecordBatch.from_pydict({"id": [0], "text": ["one two three"]})]))
    before = own_mb()
    run(batches(4))
    assert own_mb() - before < 24
