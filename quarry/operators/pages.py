"""Site-level page cleanup: repeated lines, duplicate pages, page collections, site identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.functions.urls import page_key


def _line_key(line: Column) -> Column:
    """A 64-bit name of a line as it is compared: trimmed and lower-cased."""
    return F.xxhash64(F.lower(strip(line)))


def _keys(pages: DataFrame, site: str, text: str) -> DataFrame:
    """(site, key): lines of three characters and more, once for each page; no text goes along."""
    long = F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(strip(x))), lambda x: F.length(x) >= 3)
    return pages.select(site, F.explode(F.array_distinct(F.transform(long, lambda x: F.xxhash64(x)))).alias("key"))


def repeated_keys(pages: DataFrame, site: str, text: str, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(site, key, pages) of the lines that stand on at least max(3, ceil(share * pages of the site)) pages; none for sites under three pages. Counts of 64-bit names are combined before the shuffle."""
    total = pages.groupBy(site).agg(F.count(F.lit(1)).alias("site_pages")).where(F.col("site_pages") >= least_pages)
    counted = _keys(pages, site, text).groupBy(site, "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= 3)
    return counted.join(total, site).where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.lit(share) * F.col("site_pages")))).drop("site_pages")


def repeated_lines(pages: DataFrame, site: str, page: str, text: str, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(site, line, pages): the lines of repeated_keys. Their text is fetched from the pages by key, for the few that repeat."""
    found = repeated_keys(pages, site, text, share, least_pages)
    lines = pages.select(site, F.explode(F.transform(F.split(text, "\n"), lambda x: F.lower(strip(x)))).alias("line")).withColumn("key", F.xxhash64("line"))
    return lines.join(found, [site, "key"]).groupBy(site, "key").agg(F.min("line").alias("line"), F.min("pages").alias("pages")).drop("key")


def remove_repeated_lines(pages: DataFrame, site: str, page: str, text: str, share: float = 0.5, most_broadcast: int = 200_000) -> DataFrame:
    """pages with the site's repeated lines taken out of text.

    The repeated lines of a site are an array of 64-bit keys. Up to most_broadcast keys in all they go to every task, so no text is shuffled; beyond that the join shuffles by site and Spark splits large sites.
    """
    keys = repeated_keys(pages, site, text, share)
    found = keys.groupBy(site).agg(F.collect_list("key").alias("_repeated"))
    few = found.agg(F.sum(F.size("_repeated"))).first()[0] or 0
    out = pages.join(F.broadcast(found) if few <= most_broadcast else found, site, "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_repeated", _line_key(x)))
    return out.withColumn(text, F.when(F.col("_repeated").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_repeated")


def fingerprint(text):
    """SHA-256 of lower-cased text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def reject_duplicate_pages(pages: DataFrame, site: str, url: str, text: str, seq: str) -> DataFrame:
    """The first page of each key, then of each content (pages without text are never duplicates by content). seq tells the pages of a site apart.

    Which pages stay is decided on keys and hashes alone; the pages are then joined once.
    """
    content = F.when(F.length(strip(F.coalesce(F.col(text), F.lit("")))) > 0, fingerprint(F.col(text))).otherwise(F.concat(F.lit("#"), F.col(seq).cast("string")))
    narrow = pages.select(site, seq, page_key(F.col(url)).alias("_key"), content.alias("_print"))
    first = narrow.groupBy(site, "_key").agg(F.min(F.struct(seq, "_print")).alias("_f")).select(site, f"_f.{seq}", "_f._print")
    kept = first.groupBy(site, "_print").agg(F.min(seq).alias(seq)).select(site, seq)
    return pages.join(kept, [site, seq], "left_semi")
