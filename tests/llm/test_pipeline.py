"""The stages of the pipeline, each held against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_exact_dedup import LOWER
from test_near_dedup import brute
from treeloom.llm import toxicity
from treeloom.llm.common import staged, table
from treeloom.llm.tokenization import byte_encoder

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        if name != "packing":
            assert out.columns == columns
        kept.append((name, docs.collect(), out.collect()))
        docs = out
    for name, given, got in kept:
        ids = Counter(r["doc_id"] for r in got)
        if name == "toxicity":
            model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
            f = toxicity.Featurizer(model.odds)
            assert set(ids) == {r["doc_id"] for r in given if model.score(f.matrix([r["text"] or ""]))[0] < 0.3}
        elif name == "exact dedup":
            last = {}
            for r in given:
                t = (r["text"] or "").translate(LOWER)
                last[t] = max(last.get(t, -1), r["doc_id"])
            assert ids == Counter(last.values())
        elif name == "near dedup":
            want = brute([(r["doc_id"], r["text"]) for r in given], 5, 80)
            assert set(ids) == {d for d, (_, c) in want.items() if c == d}
        elif name == "mixing":
            assert set(ids) <= {r["doc_id"] for r in given} and max(ids.values()) <= 3
        else:
            encode = byte_encoder("byte_bpe_50k.json")
            tokens = Counter()
            for r in got:
                tokens[r["doc_id"]] += r["length"]
            want = Counter()
            for r in given:
                want[r["doc_id"]] += len(encode(r["text"] or "")) + 1
            assert tokens == want
