"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, license_scan, mixing, near_dedup, packing, secret_scan, token_files, toxicity, url_filter
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, secret_scan.KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", F.element_at(kinds, f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] < len(secret_scan.BASE_KINDS))
    number = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.BASE_KINDS)],
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 12 half keys, 144 tables.
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), miss=2.2e-5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.try_element_at("positions", F.lit(1)).alias("position"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.filter_captures(url_filter.page_captures(pages), url_filter.page_list(pages)).withColumnRenamed("key", "page_id")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched_at", "since")})


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_exact_dedup, op3_secret_scan, op4_near_dedup, op5_mixing, op6_toxicity, op7_license_scan, op8_fingerprints, op9_url_filter, op10_token_files)
}
