"""Secret scan with an incremental blob ledger.

A version of a document is stored under the SHA-256 of its text.  The ledger has
an entry for each (blob, rules version) that was scanned.  A run scans only
pairs that are not in it, each blob once however many paths have it, and joins
the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, scratch_path

# The kinds, in the order in which equal starts are listed.
BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("private_key", "bearer", "provider", "jwt")
KINDS = BASE_KINDS + EXTRA_KINDS
RULES_VERSION = "1"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_EXTRA = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "bearer": re.compile(r"\bBearer [A-Za-z0-9._~+/-]{20,}", re.A),
    "provider": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", re.A),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A),
}
#: Text without any of these has no match of the kind; looking for a fixed string is quick.
_HINTS = {
    "private_key": ("PRIVATE KEY-----",),
    "bearer": ("Bearer ",),
    "provider": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_"),
    "jwt": ("eyJ",),
}
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of every span, in code points, in order."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    if (b"=" in low or b":" in low) and any(w in low for w in _ASSIGN_WORDS):
        found += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in _HEX.finditer(text)]
    for k, kind in enumerate(EXTRA_KINDS, len(BASE_KINDS)):
        if any(h in text for h in _HINTS[kind]):
            found += [(*m.span(), k) for m in _EXTRA[kind].finditer(text)]
    return sorted(found, key=lambda f: (f[0], f[2]))


def _blobs(docs: DataFrame) -> DataFrame:
    text = full_text()
    return docs.select(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("blob"), text.alias("text"))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a blob that this task has not met; it keeps 32 bytes of each."""
    met: set[bytes] = set()
    for batch in batches:
        take = []
        for i, blob in enumerate(batch["blob"].to_pylist()):
            if blob not in met:
                met.add(blob)
                take.append(i)
        if take:
            yield batch if len(take) == batch.num_rows else batch.take(pa.array(take))


_FOUND = pa.schema([("blob", pa.binary()), ("rules", pa.string()), ("findings", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])))])
LEDGER = "blob binary, rules string, findings array<struct<start: bigint, end: bigint, kind: int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _first_of_each(batches):
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan_text(t.as_py())] for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["blob"].cast(pa.binary()), pa.array([RULES_VERSION] * len(found)), pa.array(found, _FOUND.field("findings").type)], schema=_FOUND)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New entries (blob, rules, findings) for the blobs of ``docs`` that ``ledger`` lacks.

    Copies within a task collapse before the shuffle, copies in different tasks
    meet at the task that their blob hashes to and are scanned once there.
    """
    blobs = _blobs(docs)
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")
    once = blobs.mapInArrow(_first_of_each, "blob binary, text string")
    return once.repartition("blob").mapInArrow(_scan, LEDGER)


def scan(docs: DataFrame, *, ledger_path: str | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, blob, findings (in order).

    ``ledger_path`` names a Parquet ledger that is read, and extended with what
    this run scanned; without it the run starts from an empty ledger.  A null
    text is an empty one, without findings.  Repeated rows and copies each get
    all findings of their text.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    old = None
    if ledger_path and _exists(spark, ledger_path):
        old = spark.read.schema(LEDGER).parquet(ledger_path)
    path = ledger_path or scratch_path(spark, "blob-ledger")
    update_ledger(docs, old).write.mode("append").parquet(path)
    ledger = spark.read.schema(LEDGER).parquet(path)
    hits = ledger.filter((F.col("rules") == RULES_VERSION) & (F.size("findings") > 0)).select("blob", "findings")
    paths = docs.select("doc_id", F.unhex(F.sha2(F.encode(full_text(), "UTF-8"), 256)).alias("blob"))
    empty = F.array().cast("array<struct<start: bigint, end: bigint, kind: int>>")
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("findings", empty).alias("findings"))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
