"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The features are densities of a fixed lexicon and of word stems learned from
labels, closeness of such words to second-person pronouns, and rates of capitals,
punctuation and obfuscation.  Labels, language, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import full_text, staged

# Words of abuse, and second-person pronouns, of the languages in use.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown"
    " imbecile fool filth vermin hate kill ugly freak pig rat bastard shit fuck fucking bitch asshole crap damn"
    " dumm idioten dummkopf abschaum arschloch scheisse verdammt hässlich widerlich trottel"
    " imbécile connard salope merde débile ordure crétin pourri"
    " idiota estúpido estúpida imbécil basura mierda asqueroso tonto cabrón escoria".split()
)
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())

FEATURES = (
    "lexicon density", "lexicon count", "stem density", "stem count", "sum of stem odds", "largest stem odds", "closeness to second person",
    "second person density", "capital rate", "all-capital words", "exclamation rate", "punctuation rate", "symbol runs", "obfuscated words",
    "words", "letters a word", "repeated letters",
)
_WORDS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"[%$#&*@!]{2,}")
_LEET = re.compile(r"\b\w*[^\W\d_][0@$*1!3]+[^\W\d_]\w*")
_REPEATS = re.compile(r"([^\W\d_])\1{2,}")
_PLAIN = str.maketrans("0@$*1!3", "oasxiie")
#: Lengths of the stems, first characters of a word, that odds are learned for.
STEMS = (3, 4, 5)
#: Words whose weight a task keeps.
_KNOWN = 300_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row's label is kept from training."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Featurizer:
    """The features of a text, given the learned log odds of stems."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.known = odds, {}

    def weight(self, word: str) -> float:
        found = [self.odds[s] for k in STEMS if (s := word[:k]) in self.odds and len(word) >= k]
        return max(found, default=0.0)

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORDS.findall(low)
        n = max(1, len(words))
        known = self.known
        if len(known) > _KNOWN:
            known = self.known = {}
        values = []
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = (w in LEXICON, self.weight(w), w in SECOND)
            values.append(v)
        bad = [i for i, v in enumerate(values) if v[0] or v[1] > 0]
        lexicon = sum(1 for i in bad if values[i][0])
        stems = [values[i][1] for i in bad if values[i][1] > 0]
        close = 0
        you = 0
        if any(v[2] for v in values):
            at = [i for i, v in enumerate(values) if v[2]]
            you = len(at)
            if bad:
                near = np.searchsorted(at, bad)
                close = sum(1 for i, k in zip(bad, near) if (k < you and at[k] - i <= 5) or (k > 0 and i - at[k - 1] <= 5))
        size = max(1, len(text))
        letters = sum(map(len, words))
        spaces = text.count(" ") + text.count("\n")
        caps = 0 if low == text and text.isascii() else sum(map(str.isupper, text))
        runs = len(_RUNS.findall(text)) if any(c in text for c in "%$#&*@!") else 0
        leet = 0
        if any(c in text for c in "0@$*1!3"):
            leet = sum(1 for m in _LEET.findall(low) if m.translate(_PLAIN) in LEXICON)
        return [
            lexicon / n, np.log1p(lexicon), len(stems) / n, np.log1p(len(stems)), sum(stems) / n, max(stems, default=0.0), close / n,
            you / n, caps / size, sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / n, (text.count("!") + text.count("?")) / size,
            max(0, size - letters - spaces) / size, runs / n, leet, np.log1p(len(words)), letters / n, len(_REPEATS.findall(low)) / n,
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


class Model:
    """What ``score`` needs: stems, trees and calibration.  Without enough labels, a fixed rule."""

    def __init__(self, odds: dict[str, float], trees: BoostedTrees | None, calibration: Isotonic | None):
        self.odds, self.trees, self.calibration = odds, trees, calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.clip(0.05 + 20 * x[:, 0], 0, 0.95)
        p = self.trees.probability(x)
        # A share of the raw probability tells apart what calibration ties.
        return np.clip(0.97 * self.calibration(p) + 0.03 * p, 0, 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text, toxic and fold of at most ``sample`` labelled rows, chosen by a hash of doc_id."""
    usable = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    # The limit bounds what is broadcast.
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")
    # Of rows that share a doc_id one counts, so that there are at most ``sample``.
    texts = docs.select("doc_id", full_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    one_each = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return staged(one_each.select(fold, "toxic", "text"), "training-rows")


FOLDS = 5


def learn_stems(rows: DataFrame, most: int) -> list[tuple[int, dict[str, float]]]:
    """Log odds of stems for each fold left out, and for none (fold -1): at most ``most`` of each.

    A stem's odds are over the training rows with a word that begins with it.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    stems = F.array_distinct(F.flatten(F.transform(F.array_distinct(word), lambda w: F.filter(F.array(*[F.substring(w, 1, k) for k in STEMS]), lambda s: F.length(s) >= STEMS[0]))))
    counts = rows.select("fold", "toxic", F.explode(stems).alias("stem")).groupBy("stem").agg(
        *[F.sum(F.when(F.col("fold") == f, F.col("toxic")).otherwise(0)).alias(f"a{f}") for f in range(FOLDS)],
        *[F.sum(F.when(F.col("fold") == f, 1 - F.col("toxic")).otherwise(0)).alias(f"b{f}") for f in range(FOLDS)])
    a_all, b_all = (sum((F.col(f"{c}{f}") for f in range(1, FOLDS)), F.col(f"{c}0")) for c in "ab")
    # At least three toxic rows and three times the share of the others; the
    # strongest are collected, a bounded number.
    totals = rows.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    a_n, b_n = (totals["a"] or 0) + 1.0, (totals["b"] or 0) + 1.0
    odds = F.log((a_all + 0.2) / a_n) - F.log((b_all + 0.2) / b_n)
    top = counts.filter((a_all >= 3) & (odds > 1.1)).orderBy((odds * F.log(a_all)).desc(), "stem").limit(most).collect()
    out = []
    for left in range(-1, FOLDS):
        kept = [f for f in range(FOLDS) if f != left]
        learned = {}
        for r in top:
            a, b = sum(r[f"a{f}"] for f in kept), sum(r[f"b{f}"] for f in kept)
            v = float(np.log((a + 0.2) / a_n) - np.log((b + 0.2) / b_n))
            if a >= 2 and v > 1.1:
                learned[r["stem"]] = v
        out.append((left, learned))
    return out


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = 12_000, stems: int = 4_000) -> Model:
    """A model from at most ``sample`` labelled rows that are not held out.

    The rows' features come from stems learned on the other folds, so the trees
    see how far learned stems can be trusted; the calibration is from
    predictions for rows that its trees were not fitted on.
    """
    rows = training_rows(docs, labels, label, sample)
    by_label = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if min(by_label.get(0, 0), by_label.get(1, 0)) < 5:
        return Model({}, None, None)
    learned = learn_stems(rows, stems)
    left_out = dict(learned)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {f: Featurizer(o) for f, o in left_out.items()}
        for b in batches:
            x = [of[f](t) for f, t in zip(b["fold"].to_pylist(), b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["fold"], b["toxic"], pa.array(x, pa.list_(pa.float64()))], names=["fold", "toxic", "x"])

    # Bounded by ``sample``: a few numbers for each row, no texts.
    got = rows.mapInArrow(features, "fold int, toxic int, x array<double>").orderBy("fold", "toxic", "x").collect()
    fold, y = np.array([r["fold"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    x = np.array([r["x"] for r in got])
    p = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            p[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).probability(x[fold == f])
    return Model(left_out[-1], BoostedTrees().fit(x, y), Isotonic().fit(p, y))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """A row per row of ``docs``: doc_id, held_out, score in [0, 1], predicted.

    A null text is scored as an empty one; an empty text has no words and gets
    the score of its features, as any other.  Repeated rows each get their score.
    An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer(model.odds)
        for b in batches:
            s = model.score(of.matrix(b["text"].to_pylist())) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), full_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with all their columns, whatever their names.

    A null text is an empty one, a text of any length is read whole; repeated rows
    stay or go together, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer(model.odds)
        for b in batches:
            if b.num_rows:
                s = model.score(of.matrix([t or "" for t in b["text"].to_pylist()]))
                yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
