"""Fetched pages to a corpus, and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html, text, urls


def corpus(pages: DataFrame, kind: str = "auto", min_chars: int = 1) -> DataFrame:
    """(id, page_id, url, title, domain, content_hash, text): main texts, cleaned, each once (the smallest page_id stays)."""
    rows = pages.select("page_id", "url", text.page_clean(html.page_text_column(F.col("html"), kind)).alias("text"), urls.title(F.col("html")).alias("title"))
    rows = rows.where(F.length("text") >= min_chars).withColumn("content_hash", urls.content_hash(F.col("text")))
    # the first page of a text by min_by: one partial aggregation, whatever the number of copies
    first = rows.groupBy("content_hash").agg(F.min(F.struct("page_id", "url", "title", "text")).alias("p"))
    return first.select(F.substring("content_hash", 1, 16).alias("id"), "p.page_id", "p.url", "p.title", urls.domain(F.col("p.url")).alias("domain"), "content_hash", "p.text")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link): valid links of the same host, each once for a page."""
    each = pages.select("page_id", "url", F.explode(html.links_column(F.col("html"), F.col("url"))).alias("link"))
    return each.where(urls.is_valid(F.col("link"), F.col("url"))).select("page_id", "link").distinct()


def frontier(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): what is reached from ``seeds`` (url) over ``edges`` (url, link) in so many steps, with the least depth."""
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct()
    level = seen
    for d in range(1, depth + 1):
        level = level.join(edges, "url").select(F.col("link").alias("url"), F.lit(d).alias("depth")).distinct().join(seen.select("url"), "url", "left_anti")
        seen = seen.unionAll(level)
    return seen


def corpus_counts(pages: DataFrame, text: str = "text", unique: bool = True) -> DataFrame:
    """(total, empty, duplicates, added) of fetched pages with their texts; counted by hash first, so copies are no hot task."""
    full = F.col(text).isNotNull() & (F.col(text) != "")
    by_text = pages.groupBy(F.when(full, urls.content_hash(F.col(text))).alias("h")).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    added = F.when(F.col("h").isNotNull(), F.lit(1) if unique else F.col("n")).otherwise(0)
    out = by_text.agg(zero("n").alias("total"), zero(F.when(F.col("h").isNull(), F.col("n"))).alias("empty"), zero(added).alias("added"))
    return out.select("total", "empty", (F.col("total") - F.col("empty") - F.col("added")).alias("duplicates"), "added")
