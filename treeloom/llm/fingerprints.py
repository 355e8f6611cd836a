"""Document fingerprints from modular prefix arrays.

The prefix array of a text holds, for every i, the polynomial hash of its first i
characters.  Two subtractions and a product give the hash of any span, so spans
compare in constant time, and the longest common extension of two places is a
binary search.  A fingerprint is the text's length, the hash of the whole, and a
sketch: the smallest of the hashes of all spans of ``SPAN`` characters.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text
from .ranges import in_ranges

# The Mersenne prime 2**31 - 1 and two bases; a pair of hashes has 62 bits.
PRIME = np.uint64(2**31 - 1)
BASES = (911_382_323, 972_663_749)
SPAN = 12
SKETCH = 64
#: Characters of a step, which bound the powers that a task keeps.
_STEP = 1 << 16


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


@functools.lru_cache(maxsize=None)
def _powers(base: int, inverse: bool) -> np.ndarray:
    """base**i, or its inverse, modulo PRIME, for i up to _STEP."""
    b = pow(base, -1, int(PRIME)) if inverse else base
    out = np.ones(1, dtype=np.uint64)
    while len(out) <= _STEP:
        out = np.concatenate([out, _fold(out * np.uint64(pow(b, len(out), int(PRIME))))])
    return out[: _STEP + 1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _scales(base: int, first: int, n: int, inverse: bool) -> np.ndarray:
    """base**i (or inverse) for i from ``first``, n of them."""
    power = _powers(base, inverse)
    b = pow(base, -1, int(PRIME)) if inverse else base
    parts, at = [], first
    while at < first + n:
        block, within = divmod(at, _STEP)
        m = min(_STEP - within, first + n - at)
        own = power[within : within + m]
        parts.append(own if block == 0 else _fold(own * np.uint64(pow(b, block * _STEP, int(PRIME)))))
        at += m
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


class PrefixHashes:
    """Prefix arrays of a text under both bases; ``extend`` makes those of a prefix plus a tail."""

    def __init__(self, codes: np.ndarray, start: tuple[np.ndarray, ...] | None = None):
        self.tables = []
        for k, base in enumerate(BASES):
            head = np.zeros(1, dtype=np.uint64) if start is None else start[k]
            first = len(head) - 1
            terms = _fold((codes + np.uint64(1)) * _scales(base, first, len(codes), False))
            tail = _fold(head[-1] + np.cumsum(terms))
            self.tables.append(np.concatenate([head, tail]))
        self.n = len(self.tables[0]) - 1

    def extend(self, keep: int, tail: np.ndarray) -> PrefixHashes:
        """The arrays of the first ``keep`` characters followed by ``tail``."""
        return PrefixHashes(tail, tuple(t[: keep + 1] for t in self.tables))

    def spans(self, starts: np.ndarray | int, length: int) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` from ``starts``; equal spans have equal ones."""
        starts = np.atleast_1d(np.asarray(starts, dtype=np.int64))
        parts = []
        for base, t in zip(BASES, self.tables):
            difference = t[starts + length] + PRIME - t[starts]
            whole = len(starts) and starts[-1] - starts[0] == len(starts) - 1
            scale = _scales(base, int(starts[0]), len(starts), True) if whole else np.concatenate([_scales(base, int(s), 1, True) for s in starts])
            parts.append(_fold(_fold(difference) * scale))
        return (parts[0] << np.uint64(31)) | parts[1]

    def whole(self) -> int:
        return int(self.spans(0, self.n)[0])


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """How many characters a[i:] and b[j:] have in common at their starts."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.spans(i, middle)[0] == b.spans(j, middle)[0]:
            low = middle
        else:
            high = middle - 1
    return low


class Fingerprint:
    """n characters, the hash of the whole, and the smallest span hashes in order."""

    def __init__(self, h: PrefixHashes):
        self.n, self.hash = h.n, h.whole() if h.n else 0
        if h.n < SPAN:
            sketch = np.array([self.hash], dtype=np.uint64) if h.n else np.empty(0, dtype=np.uint64)
        else:
            sketch = h.spans(np.arange(h.n - SPAN + 1), SPAN)
            # Span hashes are spread by a product, else the smallest would prefer low characters.
            sketch = (sketch * np.uint64(0x9E3779B97F4A7C15)) ^ (sketch >> np.uint64(29))
            if len(sketch) > 8 * SKETCH:
                # Repeated spans may leave too few distinct ones; then all are looked at.
                few = np.unique(np.partition(sketch, 4 * SKETCH)[: 4 * SKETCH])
                sketch = few if len(few) >= SKETCH else np.unique(sketch)
            else:
                sketch = np.unique(sketch)
        self.sketch = sketch[:SKETCH]

    def __str__(self) -> str:
        return f"{self.n:x}.{self.hash:016x}." + self.sketch.astype(">u8").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """The share of spans that two texts have in common, by their sketches: 2|A & B| / (|A| + |B|)."""
        if (self.n, self.hash) == (other.n, other.hash):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        both = np.union1d(self.sketch, other.sketch)[:SKETCH]
        shared = np.intersect1d(np.intersect1d(self.sketch, other.sketch, assume_unique=True), both, assume_unique=True)
        j = len(shared) / len(both)
        return 2 * j / (1 + j)


def parse(fingerprint: str) -> Fingerprint:
    """The fingerprint of its string."""
    n, whole, sketch = fingerprint.split(".")
    out = Fingerprint.__new__(Fingerprint)
    out.n, out.hash, out.sketch = int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(sketch), ">u8").astype(np.uint64)
    return out


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_next(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """(range, guest, doc_id, text), sorted, such that in a range the next row is the next document.

    The first document of the range that follows is a guest at the end of each
    range, the first of all at the end of the last; so no order over all documents
    is needed, and only one document of each range is sent twice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    ranged, heads = in_ranges(docs, rows_per_range)
    following = list(zip([r for r, _ in heads], [d for _, d in heads[1:] + heads[:1]]))
    spark = docs.sparkSession
    # One row for each range.
    to = F.broadcast(spark.createDataFrame(following, "range int, head long"))
    guests = docs.join(to, docs["doc_id"].eqNullSafe(to["head"])).groupBy("range").agg(F.first("head").alias("doc_id"), F.min("text").alias("text"))
    rows = ranged.select("range", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests.select("range", F.lit(True).alias("guest"), "doc_id", "text"))
    return rows.repartition("range").sortWithinPartitions("range", "guest", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, *, rows_per_range: int = 512) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last quarter replaced by as many
    characters from the start of the next document, in ascending order of doc_id,
    after the last the first.  Its prefix arrays are those of the kept part,
    extended.  near_edited and near_next are the likeness of the document's
    fingerprint to the edited text's and to the next document's.

    A null text is empty, a null doc_id comes first, repeated ids are in order of
    their texts.  A single document is its own next one.  An empty table gives an
    empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        rows: list[tuple] = []
        for batch in batches:
            for part, guest, doc_id, text in zip(batch["range"].to_pylist(), batch["guest"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                hashes = PrefixHashes(code_points(text))
                now = (part, guest, doc_id, text, hashes, Fingerprint(hashes))
                if held is not None and held[0] == part and not held[1]:
                    rows.append(_edit(held, now))
                held = now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                rows = []

    return with_next(docs, rows_per_range).mapInArrow(run, OUT)


def _edit(own: tuple, following: tuple) -> tuple:
    _, _, doc_id, text, hashes, print_ = own
    n = len(text)
    cut = n // 4
    head = following[3][:cut]
    edited = text[: n - cut] + head
    other = Fingerprint(hashes.extend(n - cut, code_points(head))) if cut else print_
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, str(print_), str(other), print_.likeness(other), print_.likeness(following[5])
