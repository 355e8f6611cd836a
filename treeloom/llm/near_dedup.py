"""Near-duplicate documents by MinHash with tensored banding.

A document's minhashes form two collections of ``halves`` half keys.  Every pair
of one half key from each is the key of one table, so ``halves`` squared tables
need only ``2 * halves * width`` minhashes.  Tables are not built for documents
whose half keys are their own: a key can only be shared by documents that share
both halves.  Candidates are verified on full shingle sets.

A bucket's documents are compared with its leader, the one whose half keys are
the most common, as the original of a group of edited copies is.  The tables of the diagonal
come first; members that they link to a leader take no part in the other tables
where that leader leads.  Two documents
that are both linked to the leader need no comparison.  For the others, what
matters is how they differ from the leader: a document that is not linked to it
can only be linked to one that shares a difference, and most of that one's
differences, so an exact prefix join on differences finds all links without
pairing a group's members.  Documents far from the leader go to the next turn
with a leader of their own.  What is left after the turns is compared in blocks of bounded
size, screened by minhashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, full_text, release, staged
from .components import connected_components

SIGNED = "doc_id long, n_shingles long, set_hash binary, signature binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.binary())])
_BLOCK = 256
#: The Jaccard distance to a leader up to which a document is done with its turn.
_INNER = 0.25
#: Members up to which a bucket's pairs come from a join, not from blocks.
_SMALL = 32
#: Words whose hash a task keeps.
_KNOWN = 500_000


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        rng = np.random.Generator(np.random.PCG64(99))
        self.factors = rng.integers(1, 2**63, size=words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b"\n".join(words), seed=len(words))], dtype=np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > _KNOWN:
                known = self.known = {}
                new = set(words)
            digest = xxhash.xxh64_intdigest
            for w in new:
                known[w] = digest(w)
        hashes = np.array([known[w] for w in words], dtype=np.uint64)
        n = len(words) - self.words + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for i, factor in enumerate(self.factors):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : i + n] * factor
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(30)
        return np.unique(mixed)


@functools.lru_cache(maxsize=4)
def _shingler(words: int) -> Shingler:
    return Shingler(words)


@functools.lru_cache(maxsize=4)
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return (rng.integers(1, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size=count, dtype=np.uint64))


def minhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """The upper halves of the smallest of multiply-shift hashes, ``count`` of them."""
    a, b = _multipliers(count)
    best = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(best, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def sign(docs: DataFrame, *, words: int, count: int) -> DataFrame:
    """doc_id, number of shingles, a hash of the whole set, and the minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = _shingler(words)
        for batch in batches:
            sizes, hashes, signatures = [], [], []
            for text in batch["text"]:
                s = shingles_of(text.as_py())
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                signatures.append(minhashes(s, count).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())], schema=_SIGNED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")).mapInArrow(run, SIGNED)


def half_keys(classes: DataFrame, halves: int, width: int) -> DataFrame:
    """(id, h, half): half h is of the first collection below ``halves``, else of the second."""
    size = 4 * width
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(2 * halves - 1)),
        lambda h: F.struct(h.alias("h"), F.xxhash64(h, F.substring("signature", h * size + 1, F.lit(size))).alias("half")),
    )
    return classes.select("id", F.explode(rows).alias("x")).select("id", "x.h", "x.half")


def buckets(classes: DataFrame, halves: int, width: int) -> DataFrame:
    """(key, id, known, late) of every table entry that two classes or more share.

    known says how common a class's half keys are; late is 0 for the tables of the
    diagonal, of which each half key is in one, and 1 for all others.
    """
    keys = staged(half_keys(classes, halves, width), "half-keys")
    shared = keys.groupBy("h", "half").count().filter("count > 1")
    mine = keys.join(shared, ["h", "half"]).groupBy("id").agg(F.collect_list(F.struct("h", "half")).alias("own"), F.sum("count").alias("known"))
    first = F.filter("own", lambda x: x["h"] < halves)
    second = F.filter("own", lambda x: x["h"] >= halves)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct(
        F.xxhash64(a["h"], b["h"], a["half"], b["half"]).alias("key"), F.when(b["h"] - a["h"] == halves, 0).otherwise(1).alias("late")))))
    entries = staged(mine.select("id", "known", F.explode(pairs).alias("t")).select("id", "known", "t.*"), "table-entries")
    release(keys)
    # Documents that agree in much share many tables; of buckets with the same
    # members (by count, sum and xor of two hashes of them) one is enough.
    members = entries.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min("late").alias("late"),
        F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(20,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("x"),
    )
    crowded = members.filter("n > 1").groupBy("n", "s", "x").agg(F.min(F.struct("late", "key")).alias("one")).select("one.key")
    out = staged(entries.join(crowded, "key").select("key", "id", "known", "late"), "buckets")
    release(entries)
    return out


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full sets of the documents in ``ids``, as sorted little-endian 64-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = _shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([shingles_of(t.as_py()).tobytes() for t in part["text"]], pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), full_text().alias("text"))
    return texts.join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def least_agreement(count: int, percent: int) -> int:
    """Minhashes in which a pair at the threshold agrees but for a chance of 3e-7."""
    j = percent / 100
    return int(count * j - 5 * (count * j * (1 - j)) ** 0.5)


def screen(pairs: DataFrame, classes: DataFrame, count: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose minhashes agree often enough to be worth the full sets."""
    least = least_agreement(count, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, count) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_()))

    one = classes.select(F.col("id").alias("a"), F.col("signature").alias("x"))
    two = classes.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


_MEASURED = "a long, b long, both long, n_a long, n_b long, apart binary"


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def measure(pairs: DataFrame, sets: DataFrame, within: float = -1.0) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both full sets and of their intersection.

    Of pairs at a distance of at most ``within``, apart has the elements that only
    one of the two has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = _overlap(p, q)
                near = 1 - both / max(1, len(p) + len(q) - both) <= within
                got.append((both, len(p), len(q), np.setxor1d(p, q, assume_unique=True).astype("<u8").tobytes() if near else None))
            more = [pa.array([g[k] for g in got], pa.int64() if k < 3 else pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *more], names=["a", "b", "both", "n_a", "n_b", "apart"])

    return _with_sets(pairs, sets).mapInArrow(run, _MEASURED)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    # Sets are large, so neither side is to be broadcast, at any size.
    return pairs.hint("merge").join(two.hint("merge"), "b").hint("merge").join(one.hint("merge"), "a").select("a", "b", "x", "y")


def linked(percent: int) -> Column:
    """Whether a measured pair is a link."""
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def distance() -> Column:
    """The Jaccard distance of a measured pair."""
    return 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    return measure(pairs, sets).filter(linked(percent)).select("a", "b")


def leaders(entries: DataFrame) -> DataFrame:
    """(key, leader) of every bucket with two members or more: the one with the most common half keys."""
    order = F.struct("known", F.xxhash64("id").alias("o"), "id")
    return entries.groupBy("key").agg(F.max(order).alias("top"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("top.id").alias("leader"))


def difference_links(near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between documents near one leader, of which one is not linked to it; and a table to release after.

    ``near`` has measured pairs (a leader, b member, with apart).  Let D be a
    member's symmetric difference to the leader.  The symmetric difference of two
    members is that of their D, and they are linked if it is at most
    c = (1 - t) / (1 + t) times the sum of their sizes.  For x not linked to the
    leader this asks of any y that at least half of D(y), give or take c times its
    difference in size, is in D(x).  So one of the rarest elements of D(y), as many
    as may be missing and one more, is in D(x): the join is on those, with a bound
    on what can follow.  Whether a pair is a link is seen from their D.
    """
    c = (100 - percent) / (100 + percent)
    loose = near.filter(~linked(percent)).select("a").distinct()
    mine = near.join(loose, "a", "left_semi")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 8 for x in batch["apart"]], dtype=np.int64)
            at = np.repeat(np.arange(batch.num_rows), sizes)
            fixed = batch.select(["a", "b", "n_a", "n_b", "free"]).take(pa.array(at))
            elements = np.frombuffer(b"".join(x.as_py() for x in batch["apart"]), "<i8")
            yield pa.RecordBatch.from_arrays([*fixed.columns, pa.array(sizes[at]), pa.array(elements)], names=["a", "b", "n_a", "n_b", "free", "d", "e"])

    flagged = mine.select("a", "b", "n_a", "n_b", (~linked(percent)).alias("free"), "apart")
    found = staged(flagged.mapInArrow(spread, "a long, b long, n_a long, n_b long, free boolean, d long, e long"), "differences")
    often = found.groupBy("a", "e").agg(F.count("*").alias("often")).filter("often > 1")
    order = Window.partitionBy("a", "b").orderBy("often", "e")
    # Elements of one document alone come first in the order, match nothing, and only count.
    alone = F.col("d") - F.count("*").over(Window.partitionBy("a", "b"))
    ranked = found.join(often, ["a", "e"]).withColumn("place", alone + F.row_number().over(order))
    need = F.greatest(F.lit(1), F.ceil((F.col("d") - c * (F.col("n_b") - F.col("n_a"))) / 2 - 1e-6))
    index = ranked.filter(F.col("place") <= F.col("d") - need + 1).select("a", "e", F.col("b").alias("y"), F.col("n_b").alias("n_y"), F.col("d").alias("d_y"), (F.col("d") - F.col("place") + 1).alias("left"))
    probe = found.filter("free").select("a", "e", F.col("b").alias("x"), F.col("n_b").alias("n_x"), F.col("d").alias("d_x"))
    both = (F.col("d_x") + F.col("d_y") - c * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-6
    same = probe.join(index, (probe["a"] == index["a"]) & (probe["e"] == index["e"]) & (F.col("x") != F.col("y")) & (F.col("left") >= both))
    pairs = same.select(probe["a"], F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q, n, m in zip(batch["d_x"], batch["d_y"], batch["n_x"].to_pylist(), batch["n_y"].to_pylist()):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                differ = len(p) + len(q) - 2 * _overlap(p, q) if len(p) and len(q) else len(p) + len(q)
                # |A & B| = (|A| + |B| - |A ^ B|) / 2 and |A | B| likewise with a plus.
                keep.append(100 * (n + m - differ) >= percent * (n + m + differ))
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = mine.select("a", F.col("b").alias("x"), F.col("n_b").alias("n_x"), F.col("apart").alias("d_x"))
    two = mine.select("a", F.col("b").alias("y"), F.col("n_b").alias("n_y"), F.col("apart").alias("d_y"))
    links = pairs.join(one, ["a", "x"]).join(two, ["a", "y"]).select("x", "y", "n_x", "n_y", "d_x", "d_y").mapInArrow(confirm, "a long, b long")
    return links, found


def small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of the buckets with at most ``_SMALL`` members (columns key, id, n)."""
    one = members.filter(F.col("n") <= _SMALL)
    two = one.select("key", F.col("id").alias("b"))
    met = one.withColumnRenamed("id", "a").join(two, "key").filter("a < b")
    return met.select("a", "b").distinct()


def large_pairs(members: DataFrame, classes: DataFrame, count: int, percent: int) -> DataFrame:
    """Screened pairs across components of the buckets with more members.

    A bucket's largest component is one side, everything else the other; both are
    cut into blocks by a hash, and a task compares two blocks.
    """
    least = least_agreement(count, percent)
    members = members.filter(F.col("n") > _SMALL).drop("n")
    of = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = of.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("parts")).filter("parts > 1")
    sides = members.join(
        top.select("key", F.col("top.component").alias("main"), F.col("top.n").alias("n_main"), (F.col("total") - F.col("top.n")).alias("n_rest")), "key"
    )
    n_main, n_rest = (F.ceil(F.col(c) / _BLOCK).cast("int") for c in ("n_main", "n_rest"))
    is_main = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("id"), F.when(is_main, n_main).otherwise(n_rest)).cast("int")
    # A task is (p, q): rest block p against main block q, or, with q below 0,
    # against rest block -1-q >= p.
    tasks = F.when(is_main, F.transform(F.sequence(F.lit(0), n_rest - 1), lambda p: F.struct(p.alias("p"), block.alias("q")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), n_main - 1), lambda q: F.struct(block.alias("p"), q.alias("q"))),
            F.transform(F.sequence(F.lit(0), n_rest - 1), lambda r: F.struct(F.least(block, r).alias("p"), (F.lit(-1) - F.greatest(block, r)).alias("q"))),
        )
    )
    rows = sides.select("key", "id", "component", is_main.alias("is_main"), F.explode(tasks).alias("t")).join(classes.select("id", "signature"), "id")

    def run(t: pa.Table) -> pa.Table:
        ids, comp = np.array(t["id"]), np.array(t["component"])
        main = np.array(t["is_main"].to_pylist(), dtype=bool)
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), "<u4").reshape(-1, count)
        left = np.flatnonzero(~main)
        right = np.flatnonzero(main) if main.any() else left
        a, b = [], []
        for i in left:
            hit = right[((sig[right] == sig[i]).sum(axis=1) >= least) & (comp[right] != comp[i])]
            a.append(np.minimum(ids[hit], ids[i]))
            b.append(np.maximum(ids[hit], ids[i]))
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        pair = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return rows.groupBy("key", "t").applyInArrow(run, "a long, b long").distinct()


def with_components(entries: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links)
    return entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def led(entries: DataFrame) -> DataFrame:
    """(key, id, known, leader) of every member of a bucket with others, but its leader."""
    return entries.join(leaders(entries), "key").filter("id <> leader").select("key", "id", "known", "leader")


def led_by_labels(entries: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """``led`` without what the measured pairs (a, b) have settled.

    A class's label is the smallest leader that it is linked to, or itself, so
    classes of one label are connected.  A bucket's leader is the label of its most
    common member.  A bucket of one label has nothing to find, and in others the
    members of the leader's label are linked to it already: only the rest is
    returned, so a large group of copies takes no row in the tables that follow.
    """
    label = measured.filter(linked(percent)).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
    labelled = staged(entries.join(label, "id", "left").select("key", "id", "known", F.coalesce("label", "id").alias("label")), "labelled")
    order = F.struct("known", F.xxhash64("id").alias("o"), "id", "label")
    groups = labelled.groupBy("key", "label").agg(F.max(order).alias("top"))
    lead = groups.groupBy("key").agg(F.max("top").alias("top"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("top.label").alias("leader"))
    open_ = groups.select("key", "label").join(lead, "key").filter("label <> leader")
    return labelled.join(open_, ["key", "label"]).filter("id <> leader").select("key", "id", "known", "leader")


def link_classes(docs: DataFrame, classes: DataFrame, *, words: int, percent: int, halves: int, width: int, turns: int) -> DataFrame:
    """Verified links (a, b) between classes that connect every component."""
    count = 2 * halves * width
    width_of_link = 1 - percent / 100
    ring = _INNER + width_of_link + 1e-9
    entries = buckets(classes, halves, width)
    sets = staged(shingle_sets(docs, entries.select("id").distinct(), words), "shingle-sets")
    pairs_of = lambda m: m.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = None
    for turn in range(turns):
        if turn == 0:
            # The tables of the diagonal first; the others for what these leave open.
            early = staged(measure(pairs_of(led(entries.filter("late = 0"))), sets, ring), "measured")
            members = staged(led_by_labels(entries, early, percent), "members")
            late = measure(pairs_of(members).join(early.select("a", "b"), ["a", "b"], "left_anti"), sets, ring)
            measured = early.unionByName(staged(late, "measured"))
        else:
            members = staged(led(entries), "members")
            measured = staged(measure(pairs_of(members), sets, ring), "measured")
        own = measured.filter(linked(percent)).select("a", "b")
        more, spread = difference_links(measured.filter("apart is not null"), percent)
        own = staged(own.unionByName(more), "links-found")
        release(spread)
        links = own if links is None else links.unionByName(own)
        # Within the inner ring of the leader nothing is linked to what lies
        # beyond the outer ring, by the triangle inequality; what follows is
        # among the members outside the inner ring.
        far = measured.filter(distance() > _INNER).select(F.col("a").alias("leader"), F.col("b").alias("id"))
        rest = staged(members.join(far, ["leader", "id"], "left_semi").select("key", "id", "known"), "buckets")
        release(entries, members)
        entries = rest
        sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= _SMALL:
            break
    if largest >= 2:
        counted = entries.join(sizes.filter("n > 1"), "key").select("key", "id", "n")
        pairs = screen(small_pairs(counted), classes, count, percent)
        if largest > _SMALL:
            large = staged(with_components(counted.filter(F.col("n") > _SMALL), links), "members")
            pairs = pairs.unionByName(large_pairs(large, classes, count, percent)).distinct()
        links = links.unionByName(staged(verify(staged(pairs, "pairs"), sets, percent), "links-found"))
    release(entries, sets)
    return links


def halves_for(percent: int, width: int, miss: float) -> int:
    """The fewest half keys of each collection with which a pair at the threshold meets in no table with probability ``miss`` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** width))


def near_duplicates(docs: DataFrame, *, words: int = 3, percent: int = 85, width: int = 3, miss: float = 2e-4, turns: int = 2) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their
    sets of distinct ``words``-word shingles (64-bit hashes; A-Z lower-cased,
    words between ASCII white space).  A document with fewer words has one
    shingle, one without words none, and no links.  component_id is the smallest
    doc_id reachable, kept whether it is the document's own.

    Repeated rows share all their values.  A null doc_id is compared with none
    and has a null component; it is kept.  A null text is empty.  An empty table
    gives an empty one.

    At the threshold a link's two documents meet in no table with probability
    ``miss`` at most; the more alike, the less.
    """
    halves = halves_for(percent, width, miss)
    signed = staged(sign(docs, words=words, count=2 * halves * width), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets are one class, named by its smallest document; partial
    # aggregation makes a frequent one a row of each task.
    named = staged(full.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    classes = full.join(named.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "signature")
    classes = staged(classes, "class-signatures")
    links = link_classes(docs, classes, words=words, percent=percent, halves=halves, width=width, turns=turns)
    found = connected_components(links).withColumnRenamed("id", "class_id")
    of_class = named.withColumnRenamed("id", "class_id").join(found, "class_id", "left").filter("n > 1 or component is not null")
    of_class = of_class.withColumn("component", F.coalesce("component", "class_id"))
    out = signed.join(of_class.select("set_hash", "n_shingles", "component"), ["set_hash", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever their names.

    Repeated rows stay or go together, rows with a null doc_id or without words
    stay, an empty table gives an empty one; texts of any length are read whole.
    """
    own = free_name(docs, "id")
    kept = near_duplicates(docs, **how).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[own]), "left_semi").select(*docs.columns)
