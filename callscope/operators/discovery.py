"""Looking for the pages that list calls, where a source's own addresses fail.

From each source's home page: its links are scored by label and path, the best are
kept, the best of those are opened, and what they list is classified. Each step
narrows the next: only the opened pages are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import squeeze
from callscope.operators import lexicon as L
from callscope.operators.extraction import listing_items, page_links, same_site
from callscope.operators.scoring import classified, listing_score
from callscope.sources.storage import kept

#: Links kept and pages opened a source, and addresses suggested (reports of fixed length).
LINKS, PAGES, SUGGESTED = 60, 12, 4


def plain_address(url: Column) -> Column:
    """Without a fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def promising_links(homes: DataFrame, pages: DataFrame, most: int = LINKS) -> DataFrame:
    """(source, url), (url, html) -> source, place, url, label, score: the links of the home page that may lead to listings.

    Links to the same site that score above zero, each address once with its best
    score and that label, the earliest on ties; the best ``most`` of a source, earlier ones first on ties.
    """
    at = homes.select("source", plain_address(F.col("url")).alias("at"))
    opened = pages.withColumn("at", plain_address(F.col("url"))).join(at, "at").select(F.col("source").alias("page_id"), "url", "html")
    links = page_links(opened).filter(~F.trim("href").rlike("(?i)^(#|mailto:|tel:|javascript:)") & same_site(F.col("url"), F.col("target")))
    links = links.select(F.col("page_id").alias("source"), "position", plain_address(F.col("target")).alias("url"), squeeze(F.col("label")).alias("label"))
    scored = links.withColumn("score", listing_score(F.col("label"), F.col("url"))).filter("score > 0")
    once = scored.groupBy("source", "url").agg(F.max("score").alias("score"), F.min("position").alias("first"), F.min_by("label", F.struct(-F.col("score"), F.col("position"))).alias("label"))
    w = Window.partitionBy("source").orderBy(F.col("score").desc(), "first", "url")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("source", "place", "url", "label", "score")


def page_yield(pages: DataFrame, themes=L.THEMES, statuses=L.DOC_STATUS, noise_words=L.NOISE) -> DataFrame:
    """(url, html) -> url, n_calls: how many links of a page can be classified by title and address."""
    items = listing_items(pages.select(F.col("url").alias("page_id"), "url", "html"), None, group=False)
    found = items.withColumn("c", classified(F.col("title"), F.col("url"), None, themes, statuses, noise_words))
    counted = found.groupBy("page_id").agg(F.count("c").alias("n_calls"))
    return pages.select(F.col("url").alias("page_id")).distinct().join(counted, "page_id", "left").select(F.col("page_id").alias("url"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


def replacements(homes: DataFrame, pages: DataFrame, links: int = LINKS, opened: int = PAGES, most: int = SUGGESTED, themes=L.THEMES, statuses=L.DOC_STATUS, noise_words=L.NOISE) -> DataFrame:
    """(source, url), (url, html, ...) -> source, url, label, score, n_calls, place: the pages that were opened, most calls first.

    ``place`` up to ``most`` marks the suggestions: pages that list a call at least; it is null for others.
    A link to a page that does not answer is left out; so is a source without a home page.
    Of several pages of one address that of the least url counts, of one url that of the
    least ``line`` (the place at which it was read) where the pages have one, else of the
    least ``page_id``, else of the least html.
    """
    best = kept(promising_links(homes, pages, links).filter(F.col("place") <= opened).drop("place"), "best-links")
    found = pages.withColumn("at", plain_address(F.col("url"))).join(best.select(F.col("url").alias("at")).distinct(), "at")
    first = F.struct("url", next((c for c in ("line", "page_id") if c in pages.columns), "html"))
    found = kept(found.groupBy("at").agg(F.min_by("html", first).alias("html")).select(F.col("at").alias("url"), "html"), "opened-pages")
    tried = best.join(page_yield(found, themes, statuses, noise_words), "url")
    w = Window.partitionBy("source").orderBy(F.col("n_calls").desc(), F.col("score").desc(), "url")
    ranked = tried.withColumn("rank", F.row_number().over(w))
    return ranked.select("source", "url", "label", "score", "n_calls", F.when((F.col("n_calls") > 0) & (F.col("rank") <= most), F.col("rank")).alias("place"))
