"""Following a source's pages: walks over next-page links, and the run over a source's addresses.

The pages are read once: into the links that may lead on (``extraction.pager_links``),
the addresses that answer, and the items that they list. A walk's rounds join only
these narrow tables, a round a page number; what ends a walk by its content is worked
out over the pages it has met, as a page's items are new or not whatever comes after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.text import page_url
from callscope.operators.extraction import candidate_order, pager_links
from callscope.sources.storage import kept

#: Why a walk ends at a page, in the order in which it is asked.
REASONS = ("failed", "nothing new", "empty", "repeat", "no next", "cap")


def read_once(pages: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, html), (page, position, url, relevant) -> the addresses that answer (url, n_raw) and their links onwards.

    Addresses are without fragments; of several pages of one address any answers.
    """
    at = F.regexp_replace("url", "#.*$", "")
    counted = items.groupBy(F.col("page").alias("url")).agg(F.count("*").alias("n_raw"))
    answers = pages.select(at.alias("url")).distinct().join(counted, "url", "left").select("url", F.coalesce("n_raw", F.lit(0)).alias("n_raw"))
    return answers, pager_links(pages.withColumn("url", at)).distinct()


def _numbered(number) -> Column:
    """The address of a walk's page by its number."""
    start = F.col("start")
    return F.when(F.col("way") == "template", page_url(start, number, "template")).otherwise(page_url(start, number, parameter=F.coalesce("parameter", F.lit("page"))))


def _followed(starts: DataFrame, answers: DataFrame, links: DataFrame) -> DataFrame:
    """The pages that walks meet, one round a page: by links or numbered addresses, until one fails, repeats, has no next or the most are read."""
    auto = F.col("way") == "auto"
    walk, carried = ("source", "place"), ("start", "way", "parameter", "most")
    frontier = starts.withColumn("url", F.when(auto, F.regexp_replace("start", "#.*$", "")).otherwise(_numbered(F.col("first"))))
    frontier = frontier.select(*walk, *carried, F.lit(0).alias("turn"), F.col("first").alias("page_no"), "url", F.array("url").alias("path"))
    met = None
    most = starts.agg(F.max("most")).first()[0] or 0
    answered = answers.select("url", F.lit(True).alias("ok"))
    for _ in range(most):
        here = kept(frontier.join(answered, "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False))), "walk")
        ways = here.filter(auto & F.col("ok")).join(links, "url").filter((F.col("rank") != 1) | (F.col("number") == F.col("page_no") + 1))
        onward = ways.groupBy(*walk).agg(F.min_by("target", F.struct("rank", "position")).alias("linked"))
        here = here.join(onward, list(walk), "left").withColumn("to", F.when(auto, F.col("linked")).otherwise(_numbered(F.col("page_no") + 1)))
        # The cap is met before the next address is looked at.
        end = F.when(~F.col("ok"), "failed").when(F.col("to").isNull(), "no next").when(F.col("turn") + 1 >= F.col("most"), "cap").when(F.array_contains("path", F.col("to")), "repeat")
        here = kept(here.withColumn("end", end), "walk")
        met = here if met is None else met.unionByName(here)
        goes_on = here.filter("end is null")
        if goes_on.isEmpty():
            break
        frontier = goes_on.select(*walk, *carried, (F.col("turn") + 1).alias("turn"), (F.col("page_no") + 1).alias("page_no"), F.col("to").alias("url"), F.array_append("path", F.col("to")).alias("path"))
    return frontier.select(*walk, "start", "turn", "page_no", "url").limit(0).withColumns({"ok": F.lit(False), "end": F.lit("")}) if met is None else met.select(*walk, "start", "turn", "page_no", "url", "ok", "end")


def walks(starts: DataFrame, answers: DataFrame, links: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks from every start, as pages and as items.

    starts: (source, place, start, way, parameter, first, most): way ``auto`` follows
    links, ``query`` counts the address's ``parameter`` (null: page) up from ``first``,
    ``template`` fills the number into ``{pagina}``; at most ``most`` pages. A walk ends at a page that fails, that lists nothing relevant that is new
    to the walk (but the first page), that lists nothing at all, or where the way on is
    missing or met before.

    Pages: source, place, start, turn, page_no, url, n_raw, n_new, stop (why the walk
    ends here, else null). Items: source, place, turn, page_no, position, url, the first time
    that the walk meets a relevant address.
    """
    walk = ("source", "place")
    met = kept(_followed(starts, answers, links).join(answers, "url", "left"), "walked")
    wanted = items.filter("relevant").select(F.col("page").alias("url"), "position", F.col("url").alias("item"))
    first = F.min(F.struct("turn", "position", "page_no")).alias("seen")
    new = met.filter("ok").join(wanted, "url").groupBy(*walk, "item").agg(first)
    counted = new.groupBy(*walk, F.col("seen.turn").alias("turn")).agg(F.count("*").alias("n_new"))
    rows = met.join(counted, [*walk, "turn"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    stop = F.when(~F.col("ok"), "failed").when((F.col("turn") > 0) & (F.col("n_new") == 0), "nothing new").when(F.col("n_raw") == 0, "empty").otherwise(F.col("end"))
    rows = kept(rows.withColumn("stop", stop), "walks")
    last = rows.filter("stop is not null").groupBy(*walk).agg(F.min("turn").alias("last"))
    pages = rows.join(last, list(walk)).filter("turn <= last").select(*walk, "start", "turn", "page_no", "url", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), "n_new", "stop")
    listed = new.join(last, list(walk)).filter("seen.turn <= last").select(*walk, "seen.turn", "seen.page_no", "seen.position", F.col("item").alias("url"))
    return pages, listed


def read_sources(sources: DataFrame, memory: DataFrame, pages: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run over all sources: items, the address that each is read by, and the attempts.

    sources: (source, urls, read_all, way, parameter, first, most). The addresses of a source are
    alternatives: the first that gives anything relevant is read, the remembered one
    being tried first; with ``read_all`` they are sections, all read and joined,
    each item where it is met first. The address to remember is the one that is read,
    else the first that answers.

    Items: source, place, page_no, position, url. Used: source, url. Attempts: source,
    place, url, answered, n_pages, n_items, stop.
    """
    starts = kept(candidate_order(sources, memory).withColumnRenamed("url", "start"), "starts")
    answers, links = (kept(x, "pages-once") for x in read_once(pages, items))
    read, listed = (kept(x, "walked-pages") for x in walks(starts, answers, links, items))
    tried = read.groupBy("source", "place", F.col("start").alias("url")).agg(
        F.max(((F.col("turn") == 0) & (F.coalesce("stop", F.lit("")) != "failed")).cast("int")).alias("ok"), F.count_if(F.coalesce("stop", F.lit("")) != "failed").alias("n_pages"), F.sum("n_new").alias("n_items"), F.max("stop").alias("stop")
    )
    attempts = tried.withColumn("answered", F.col("ok") == 1).drop("ok")
    whole = starts.select("source", "place", F.coalesce("read_all", F.lit(False)).alias("read_all"))
    ranked = attempts.join(whole, ["source", "place"]).filter("answered")
    # Sections are named by the first that answers, alternatives by the first that gives anything.
    best = F.min(F.struct(F.when(F.col("read_all") | (F.col("n_items") > 0), 0).otherwise(1).alias("idle"), "place", "url", "read_all")).alias("best")
    used = ranked.groupBy("source").agg(best).select("source", F.col("best.place").alias("chosen"), "best.url", "best.read_all")
    found = listed.join(used.drop("url"), "source").filter("read_all OR place = chosen")
    first = F.min(F.struct("place", "turn", "position", "page_no")).alias("seen")
    out = found.groupBy("source", "url").agg(first).select("source", "seen.place", "seen.page_no", "seen.position", "url")
    return out, used.select("source", "url"), attempts
