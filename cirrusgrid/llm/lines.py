"""Line dedup by site-relative frequency.

A line is boilerplate on a host when at least ``MIN_PAGES`` of its pages have it and their share of all
pages of the host exceeds ``RATIO``. A host has at most (lines of its average page) / RATIO such lines, so
they go to its pages as one bounded array, and pages are never taken apart.

Lines are compared without the space around them; blank lines never count and always stay. A null text has no
lines and stays null. Rows without a host are a site of their own. Repeated rows are pages of their own. Texts of
any length are taken whole. Other columns stay as they are, whatever their names, but for n_lines and n_dropped,
which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

RATIO, MIN_PAGES = 0.1, 3
#: Boilerplate lines of a bounded number are broadcast, more are joined by shuffle.
BROADCAST_LINES = 100_000

#: What separates the text lines of a raw page: its tags.
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def page_text(html: Column) -> Column:
    """The text of a raw page, a line for each run between tags; attribute values may not hold '>'."""
    return F.regexp_replace(html, TAG, "\n")


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hashes): the hashes of each host's boilerplate lines, for hosts that have any."""
    rows = pages.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _hash))
    seen = rows.select("host", F.explode(lines).alias("line")).groupBy("host", "line").count().where(F.col("count") >= min_pages)
    common = seen.join(total, "host").where(F.col("count") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("line_hashes"))


def dedup(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages without their hosts' boilerplate lines, with the columns n_lines (not blank) and n_dropped."""
    common = keep(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    few = common.agg(F.coalesce(F.sum(F.size("line_hashes")), F.lit(0))).first()[0] <= BROADCAST_LINES
    # Columns of our own go by names that no column of pages begins with.
    own = "_"
    while any(c.startswith(own) for c in pages.columns):
        own += "_"
    at, of, common_lines, here, lost = (own + n for n in ("at", "of", "common", "here", "lost"))
    common = common.select(F.col("host").alias(of), F.col("line_hashes").alias(common_lines))
    # A hot host is one side's many rows against the other side's single one, which Spark can split.
    joined = pages.withColumn(at, F.coalesce(F.col(host_col), F.lit(""))).join(F.broadcast(common) if few else common.hint("merge"), F.col(at) == F.col(of), "left")
    text = F.col(text_col)
    lines = F.split(text, "\n")
    # The host's lines that this page has, by hash sets; only these few are looked through line by line.
    joined = joined.withColumn(here, F.array_intersect(F.transform(lines, _hash), F.col(common_lines)))
    some = F.coalesce(F.size(here) > 0, F.lit(False)) & text.isNotNull()
    gone = lambda x: (F.trim(x) != "") & F.array_contains(here, _hash(x))
    joined = joined.withColumn(lost, F.when(some, F.size(F.filter(lines, gone))).otherwise(0))
    n = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    out = {
        "n_lines": F.when(text.isNotNull(), n).otherwise(0).cast("long"),
        "n_dropped": F.col(lost).cast("long"),
        text_col: F.when(some, F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n")).otherwise(text),
    }
    return joined.withColumns(out).drop(at, of, common_lines, here, lost)


SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT DISTINCT page_id, host, trim(x, ' ') AS line FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS x FROM p) WHERE trim(x, ' ') <> ''),
c AS (SELECT l.host, line FROM l JOIN t ON l.host = t.host GROUP BY l.host, line, pages HAVING count(*) >= 3 AND count(*) > 0.1 * pages),
b AS (SELECT host, list(line) AS lines FROM c GROUP BY host)
SELECT page_id, p.host AS host,
       CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' AND list_contains(coalesce(lines, []), trim(x, ' ')))), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []), trim(x, ' '))), chr(10))) AS text_sha256
FROM p LEFT JOIN b ON p.host = b.host
"""
