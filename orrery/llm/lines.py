"""Operator 7: line dedup by site-relative frequency. DataFrame functions only.

Pages are grouped by host. A line (its words joined by one space) that stands in at least MIN_PAGES pages and in more
than MAX_RATIO of the host's pages is boilerplate and is dropped from every page of that host; what is left keeps its
order and its line breaks. Blank lines are kept.

Only 64-bit line hashes are shuffled. A page has each hash once, counts are partial aggregations by (host, line), and
what comes back are the few boilerplate hashes: lines per page / MAX_RATIO for each host at most. Where these are fewer
than BROADCAST_LINES they are broadcast as a table by host and texts don't move; beyond that pages are joined with
their own dropped lines by id.

With distinct, pages of a host with the same lines count once, so a group of copies doesn't turn its own text into
boilerplate.

Cases: a null text stays null and an empty one stays empty, both count as pages; null hosts are one host; repeated rows
count as pages (with distinct once) and each is returned; an empty table gives an empty result; columns keep their names and
order, and names that begin with orrery_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize

MAX_RATIO = 0.03
MIN_PAGES = 20
BROADCAST_LINES = 200_000


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.btrim(line, F.lit(" \t\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+", " "))


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """(host, line, n_pages, n_host) of the lines that are dropped; if distinct, pages with the same lines count once."""
    rows = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text"))
    each = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), has_word), line_hash))
    if distinct:
        rows = rows.select("host", each.alias("lines")).withColumn("content", F.xxhash64(F.array_sort("lines")))
        lines = rows.select("host", "content", F.explode("lines").alias("line")).distinct()
        rows = rows.select("host", "content").distinct()
    else:
        lines = rows.select("host", F.explode(each).alias("line"))
    lines = lines.groupBy("host", "line").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("n_host"))
    return lines.join(totals, "host").filter(F.col("n_pages") > max_ratio * F.col("n_host"))


def drop_lines(pages: DataFrame, host: Column, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """pages with the column text cleaned, and orrery_dropped, the number of lines dropped, after its columns."""
    found = materialize(boilerplate(pages, host, F.col(text), max_ratio, min_pages, distinct).select("host", "line"), "boilerplate")
    rows = pages.withColumn("orrery_host", F.coalesce(host.cast("string"), F.lit("")))
    lines = F.split(text, "\n")
    if found.count() <= BROADCAST_LINES:
        by_host = F.broadcast(found.groupBy(F.col("host").alias("orrery_host")).agg(F.collect_list("line").alias("orrery_often")))
        joined = rows.join(by_host, "orrery_host", "left")
        # a set intersection, so a host with very many such lines costs a page no more than their number
        joined = joined.withColumn("orrery_lines", F.array_intersect(F.transform(F.filter(lines, has_word), line_hash), F.col("orrery_often")))
    else:
        # every distinct (host, text hash) learns its own dropped lines; the rows then meet them by that key
        key = rows.withColumn("orrery_key", F.xxhash64(F.col(text)))
        own = key.select("orrery_host", "orrery_key", F.explode(F.array_distinct(F.transform(F.filter(lines, has_word), line_hash))).alias("line")).distinct()
        mine = own.join(found.withColumnRenamed("host", "orrery_host"), ["orrery_host", "line"]).groupBy("orrery_host", "orrery_key").agg(F.collect_list("line").alias("orrery_lines"))
        joined = key.join(mine, ["orrery_host", "orrery_key"], "left")
    gone = lambda x: has_word(x) & F.array_contains("orrery_lines", line_hash(x))
    left = F.when(F.coalesce(F.size("orrery_lines"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~gone(x)))
    return joined.select(
        *[F.array_join(left, "\n").alias(c) if c == text else F.col(c) for c in pages.columns],
        F.coalesce(F.size(lines) - F.size(left), F.lit(0)).alias("orrery_dropped"),
    )
