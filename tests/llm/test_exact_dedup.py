from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from treeloom.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_decide_against_brute_force(docs, none):
    given = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for d, t in given:
        groups[t].append(d)
    for fan_in in (2, 16):
        got = exact_dedup.decide(docs, fan_in=fan_in).collect()
        want = Counter((d, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in given)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        kept = [r for r in got if r["kept"]]
        assert Counter(r["text_sha256"] for r in kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.decide(none).count() == 0


def test_drop_duplicates(docs, none):
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(LOWER) for r in docs.collect()})
    assert exact_dedup.drop_duplicates(none).count() == 0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.decide(d).collect()
    assert sorted((r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, 1, True), (3, 3, False), (3, 3, False), (3, 3, True)]
    assert exact_dedup.drop_duplicates(d).count() == 2


def test_columns_that_clash_with_internal_names(spark):
    from treeloom.llm import exact_dedup

    docs = spark.createDataFrame([(1, "a", "o1", "k1", "d"), (2, "A", "o2", "k2", "d"), (3, "b", "o3", "k3", "d"), (3, "b", "o3", "k3", "d")], "doc_id long, text string, _own string, _keep string, _digest string")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(docs).collect())) == [(2, "A", "o2", "k2", "d"), (3, "b", "o3", "k3", "d")]
