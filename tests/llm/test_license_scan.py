from __future__ import annotations

import random
import re

from treeloom.llm import license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, percent=90):
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    places = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    labels, part = {label for _, label in places}, 0.0
    for line in low.split("\n"):
        have = set(WORD.findall(line))
        for t, label in license_scan.TEMPLATES:
            want = set(t.split())
            if len(have & want) >= -(-len(want) * percent // 100):
                labels.add(label)
                part = max(part, len(have & want) / len(want))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if places else part)


def test_scan(docs, none):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for percent in (60, 90):
        got = license_scan.scan(docs, percent=percent).collect()
        assert len(got) == docs.count()
        for r in got:
            assert tuple(r)[1:] == brute(texts[r["doc_id"]], percent), texts[r["doc_id"]][:80]
    assert license_scan.scan(none).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"


def runs(text, percent):
    """Labels and score by trying the run from every word."""
    words = WORD.findall((text or "").translate(LOWER))
    labels, part = set(), 0.0
    for t, label in license_scan.TEMPLATES:
        want, n = set(t.split()), len(t.split())
        for i in range(len(words)):
            have = want & set(words[i : i + n + n // 6])
            if len(have) >= -(-len(want) * percent // 100):
                labels.add(label)
                part = max(part, len(have) / len(want))
    return labels, part


def test_wrapped(spark):
    rng = random.Random(7)
    texts = [MIT, BSD, MIT.replace("\n", "\n * "), MIT.replace(" ", "\n"), BSD.replace("\n", "\r\n# "), BSD.replace("use in", "use\nof it in"), "all\nrights\n\nreserved", "all\nthe rights\nreserved", "gnu lesser general\npublic license"]
    texts += ["word " * k + w + "\n" + "other\n" * k for k in range(0, 90, 7) for w in (MIT, BSD)]
    known = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()})
    texts += ["".join(w + rng.choice(" \n") for _ in range(9) for w in (rng.choice(license_scan.TEMPLATES)[0].split() if rng.random() < 0.6 else rng.choices(known + ["x"], k=12)) if rng.random() < 0.96) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for percent in (60, 90):
        got = {r["doc_id"]: r for r in license_scan.scan(docs, percent=percent).collect()}
        for i, t in enumerate(texts):
            *head, labels, score = brute(t, percent)
            more, part = runs(t, percent)
            assert tuple(got[i])[1:] == (*head, ",".join(sorted({x for x in labels.split(",") if x} | more)), max(score, part)), (percent, t)
        if percent == 90:
            assert [got[i]["labels"] for i in range(9)] == ["mit", "bsd", "mit", "mit", "bsd", "bsd", "all-rights-reserved", "", "lgpl"]


def test_main_path_is_native(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
