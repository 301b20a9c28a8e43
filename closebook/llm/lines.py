"""Boilerplate lines by their frequency within a site.

A line is boilerplate on a host if the share of the host's pages that contain it exceeds a ratio.
Lines are counted by digest, once a page, and combined before the shuffle. A host has at most
(lines a page) / ratio boilerplate lines, so they are gathered by host and pages look them up;
the lookup is broadcast only when measured as small, and hot hosts are split otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.operators.lookup import lookup_join
from closebook.session import staged

RATIO = 0.2
LEAST_PAGES = 5

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|br|tr|td|th|table|title|body|html|head|main|aside|form|blockquote|pre)(\s[^>]*)?/?>"
TAG = r"<[^>]*>"


def page_lines(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host`` and ``lines``: visible text of each block element, without blank ones."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, " ")
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f]+", " ")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", host.alias("host"), F.filter(lines, lambda s: s != "").alias("lines"))


def boilerplate(lines: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, digests): digests of each host's boilerplate lines."""
    pages = lines.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    site = F.xxhash64("host").alias("site")
    each = lines.select(site, F.explode(F.array_distinct(F.transform("lines", F.md5))).alias("digest"))
    counts = each.groupBy("site", F.unhex("digest").alias("digest")).agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("n") > ratio * least_pages)
    found = frequent.join(pages.select("host", "pages", site), "site").filter(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.collect_set("digest").alias("digests"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """A row per page: page_id, host, lines kept, n_lines and n_dropped.

    ``pages`` has page_id, url and html; other columns are left out. Null html has no lines; a
    null url, or one without a host, is of the host ''. Hosts of fewer than ``least_pages`` pages
    keep all. A repeated page counts as often as it occurs; equal lines of a page count once, and
    all of them go. A line goes only if its share is above the ratio, not at it.
    """
    lines = page_lines(pages)
    marked = lookup_join(lines, staged(boilerplate(lines, ratio, least_pages), "boilerplate"), ["host"])
    none = F.array().cast("array<binary>")
    kept = F.filter("lines", lambda s: ~F.array_contains(F.coalesce("digests", none), F.unhex(F.md5(s))))
    return marked.select(
        "page_id", "host", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"),
    ).withColumn("n_dropped", F.col("n_lines") - F.size("kept"))
