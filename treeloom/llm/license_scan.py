"""License scan: an exact set-similarity join of text blocks with license templates.

Every line of a document is a block, a set of words.  A block meets a template if
it has at least ``percent`` of the template's words.  So does a run of words that
goes over line breaks, if it is no longer than the template and one word more for
every six of it: a text that was wrapped is found like one on a single line.
Stretches of STRETCH words, which overlap by the longest run, are blocks as well;
what they share with a template is counted within its runs at the end.

Words are ordered by how
many blocks have them; then a block that meets a template of k words with at
least c of them must have one of the k - c + 1 rarest, which is the prefix that
the join goes by.  The length filter drops blocks of fewer than c words, the
positional filter those with too few words after the one that matched.  Both are
exact, so no block is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, full_text, staged

#: A word: digits, letters and everything beyond ASCII.
TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"

# Phrases whose places are counted, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Templates of the set join.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2", "apache-2"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
)


def _run(text: str) -> int:
    """The words of the longest run that may meet a template across line breaks."""
    n = len(text.split())
    return n + n // 6


#: Any run of a template lies within one of the stretches, which start every STEP words.
STEP = max(_run(t) for t, _ in TEMPLATES)
STRETCH = 2 * STEP


def _needed(n_words: int, percent: int) -> int:
    return -(-n_words * percent // 100)


def _places(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after the other, from 0."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    found = F.filter(F.sequence(F.lit(0), last), lambda i: _all([words[i + k] == p for k, p in enumerate(parts)]))
    return F.when(last >= 0, found).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def read_blocks(docs: DataFrame, percent: int) -> DataFrame:
    """A row per document with the counts of PHRASES and the blocks that pass the length filter.

    A block keeps only those of its words that occur in a template; others match
    nothing.  A stretch keeps where they stand as well, from 0.
    """
    sets = [set(t.split()) for t, _ in TEMPLATES]
    known = sorted(set().union(*sets))
    vocabulary = F.array(*map(F.lit, known))
    least = min(_needed(len(s), percent) for s in sets)
    low = ascii_lower(full_text())
    hint = F.lit(False)
    for phrase, _ in PHRASES:
        hint = hint | _all([F.contains("low", F.lit(w)) for w in phrase.split()])
    struct = "array<struct<place:int,label:string>>"
    places = F.concat(*[_labelled(_places(F.col("words"), p), label) for p, label in PHRASES])
    lines = F.transform(F.split("low", "\n"), lambda line: F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)))
    blocks = F.filter(F.transform("lines", lambda line: F.array_intersect(vocabulary, line)), lambda block: F.size(block) >= least)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / F.lit(STEP)).cast("int") - 2))
    known_at = lambda i: F.filter(F.transform(F.slice("words", i * STEP + 1, STRETCH), lambda w, at: F.struct(at.alias("at"), w.alias("word"))), lambda h: h["word"].isin(known))
    stretches = F.filter(F.transform(starts, known_at), lambda hits: F.size(hits) >= least)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
        .select("doc_id", lines.alias("lines"), hint.alias("hint"))
        .select("doc_id", "lines", "hint", F.flatten("lines").alias("words"))
        # Within one line the line itself is the larger block.
        .select(
            "doc_id", F.size("words").cast("long").alias("n_words"), blocks.alias("blocks"),
            F.when(F.size(F.filter("lines", lambda line: F.size(line) > 0)) > 1, stretches).alias("stretches"),
            F.when(F.col("hint"), places).otherwise(F.array().cast(struct)).alias("places"), F.monotonically_increasing_id().alias("row"),
        )
    )


def match_templates(rows: DataFrame, percent: int) -> DataFrame:
    """(row, label, part): blocks of ``rows`` and the part of a template that they have, at least ``percent``."""
    spark = rows.sparkSession
    nowhere = F.lit(None).cast("array<struct<at:int,word:string>>")
    whole = F.transform("blocks", lambda block: F.struct(block.alias("block"), nowhere.alias("hits")))
    parts = F.transform("stretches", lambda hits: F.struct(F.array_distinct(hits["word"]).alias("block"), hits.alias("hits")))
    blocks = rows.select("row", F.inline(F.concat(whole, F.coalesce(parts, F.array().cast("array<struct<block:array<string>,hits:array<struct<at:int,word:string>>>>")))))
    # The order of words: how many blocks have them, then the word.  At most as
    # many rows as the templates have words, so this and what is made from it is small.
    frequency = staged(blocks.select(F.explode("block").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word-frequency")
    literal = [F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.array(*map(F.lit, sorted(set(text.split())))).alias("words"), F.lit(_run(text)).alias("run")) for t, (text, label) in enumerate(TEMPLATES)]
    templates = spark.range(1).select(F.inline(F.array(*literal)))
    ranked = (
        templates.select("t", F.explode("words").alias("word")).join(F.broadcast(frequency), "word", "left")
        .groupBy("t").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ordered"))
    )
    need = F.ceil(F.size("ordered") * percent / 100.0).cast("int")
    prefix = (
        ranked.join(templates.select("t", "label", "words", "run"), "t").select("t", "label", "words", "run", need.alias("need"), F.size("ordered").alias("k"), F.posexplode("ordered").alias("p", "entry"))
        .filter("p <= k - need").select("t", "label", "words", "run", "need", "k", "p", F.col("entry.word").alias("word"))
    )
    # Each block's words in the same order, by a map from the word to its count.
    counts = frequency.agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    ordered = blocks.join(F.broadcast(counts)).select(
        "row", "hits", F.sort_array(F.transform("block", lambda w: F.struct(F.element_at("counts", w).alias("n"), w.alias("word")))).alias("entries"), "block",
    )
    candidates = (
        ordered.select("row", "hits", "block", F.size("entries").alias("m"), F.posexplode("entries").alias("q", "entry"))
        .select("row", "hits", "block", "m", "q", F.col("entry.word").alias("word"))
        .join(F.broadcast(prefix), "word")
        # Length, and position: what can still match after this word.  Words
        # before it in the template may have matched as well, p at most.
        .filter((F.col("m") >= F.col("need")) & (F.least("p", "q") + 1 + F.least(F.col("k") - F.col("p") - 1, F.col("m") - F.col("q") - 1) >= F.col("need")))
    )
    shared = F.size(F.array_intersect("block", "words"))
    # A stretch counts by the best of its runs; each may be taken to start at a word of the template.
    in_run = lambda first: F.array_intersect("words", F.transform(F.filter("hits", lambda h: (h["at"] >= first["at"]) & (h["at"] < first["at"] + F.col("run"))), lambda h: h["word"]))
    best = F.array_max(F.transform("hits", lambda first: F.size(in_run(first))))
    return (
        candidates.filter(shared >= F.col("need"))
        .select("row", "label", "need", "k", F.when(F.col("hits").isNull(), shared).otherwise(best).alias("both"))
        .filter("both >= need").select("row", "label", (F.col("both") / F.col("k")).alias("part"))
    )


def scan(docs: DataFrame, *, percent: int = 90) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of PHRASES, first_word and last_word are their
    smallest and largest start (words from 0, null without places), base_labels
    their labels.  labels adds those of the templates that a line or a run of
    words across lines meets; score is the largest part of a template that one
    has, 1 where a phrase stands, 0 where nothing was found.

    A null text is an empty one, without words.  Repeated rows each get their
    values.  An empty table gives an empty one.
    """
    rows = staged(read_blocks(docs, percent), "license-blocks")
    met = match_templates(rows, percent).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("part").alias("part"))
    none = F.array().cast("array<string>")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    n_base = F.size("places").cast("long")
    return rows.join(met, "row", "left").select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["place"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["place"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )
