"""URL filter: captures joined with dated list entries as of their fetch time.

A list is a log of entries: at a time, a pattern is put on or taken off.  The log
becomes validity intervals, and every capture is held against the patterns active
when it was fetched: its host and the domains above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: str | Column) -> Column:
    """The host of a URL in lower case, without user and port; null if it has none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def intervals(log: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to, category) from the log (pattern, at, action, category).

    An entry holds until the next of its pattern; valid_to is null if there is
    none.  Of several at one time the last by action and category holds: "on"
    after "off".  Entries with a null pattern or time are ignored.
    """
    log = log.filter("pattern is not null and at is not null")
    last = log.groupBy("pattern", "at").agg(F.max(F.struct(F.coalesce((F.col("action") == "on").cast("int"), F.lit(0)).alias("is_on"), "category")).alias("e"))
    by = Window.partitionBy("pattern").orderBy("at")
    spans = last.select("pattern", F.col("at").alias("valid_from"), F.lead("at").over(by).alias("valid_to"), "e")
    return spans.filter("e.is_on = 1").select("pattern", "valid_from", "valid_to", F.col("e.category").alias("category"))


def patterns_of(host: Column) -> Column:
    """The host and every domain above it with at least two labels, as (depth, pattern); an address has none above it."""
    address = host.startswith("[") | host.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    parts = F.when(address, F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(parts)
    return F.when(host.isNotNull(), F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: F.struct((n - k + 1).alias("depth"), F.array_join(F.slice(parts, k, n), ".").alias("pattern")),
    ))


def active_entries(captures: DataFrame, log: DataFrame) -> DataFrame:
    """(key, depth, pattern, valid_from, category) of all entries active at each capture's fetch time.

    ``captures`` has key, url, fetched_at.  The join is on the pattern, with the
    interval as its condition; a host with a third of the captures is split by AQE,
    as the list has few intervals for each pattern.
    """
    wanted = captures.select("key", "fetched_at", F.explode(patterns_of(host_of("url"))).alias("p")).select("key", "fetched_at", "p.depth", "p.pattern")
    spans = intervals(log)
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    return wanted.join(spans, "pattern").filter(active).select("key", "depth", "pattern", "valid_from", "category")


def filter_captures(captures: DataFrame, log: DataFrame) -> DataFrame:
    """A row per capture: key, host, fetched_at, n_active, blocked, pattern, since, category.

    pattern, since and category are of the most specific active entry; a capture
    without one is not blocked.  A URL without a host, null or malformed, has a
    null host and is not blocked.  A null fetch time meets no entry.  Captures are
    told apart by key; rows that repeat a key share its entries.
    """
    found = active_entries(captures.dropDuplicates(["key", "url", "fetched_at"]), log).groupBy("key").agg(
        F.count("*").alias("n_active"), F.max(F.struct("depth", "pattern", "valid_from", "category")).alias("e"))
    return captures.select("key", host_of("url").alias("host"), "fetched_at").join(found, "key", "left").select(
        "key", "host", "fetched_at", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"), F.col("e.pattern").alias("pattern"), F.col("e.valid_from").alias("since"), F.col("e.category").alias("category"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the table pages, which has no dates: the day is set by page_id."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return pages.select(F.col("page_id").alias("key"), "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def page_list(pages: DataFrame) -> DataFrame:
    """A list log for the hosts and domains of pages, dated and chosen by their MD5."""
    patterns = pages.select(F.explode(patterns_of(host_of("url"))).alias("p")).select("p.pattern").distinct()
    h = F.md5("pattern")
    number = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d)
    category = F.when(number(9, 1) < 5, F.lit("spam")).when(number(9, 1) < 10, F.lit("adult")).otherwise(F.lit("malware"))
    first, second, third = number(3, 2) % 200, number(3, 2) % 200 + number(5, 2) % 90 + 1, number(3, 2) % 200 + number(5, 2) % 90 + number(7, 2) % 90 + 2
    entry = lambda d, action: F.struct(day(d).alias("at"), F.lit(action).alias("action"))
    log = F.when(number(1, 1) < 4, F.array(entry(first, "on"), entry(second, "off"), entry(third, "on"))).when(number(1, 1) < 8, F.array(entry(first, "on")))
    return patterns.select("pattern", category.alias("category"), F.explode(log).alias("e")).select("pattern", "e.at", "e.action", "category")
