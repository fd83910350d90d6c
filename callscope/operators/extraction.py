"""Links, labels, pages and attachments of HTML listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import cues
from callscope.functions.dates import settled
from callscope.functions.text import contains_any, file_type, generic_label, glued_cases, host_of, is_next_label, let, normalise_words, path_of, squeeze, strip_accents
from callscope.sources.blocks import listing_links

# Hosts and patterns of share links.
SOCIAL = ("linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "youtu.be", "wa.me", "api.whatsapp.com", "t.me", "telegram.me", "pinterest.com", "addthis.com", "sharethis.com")
SHARE_URLS = ("/sharing/", "/sharer", "/intent/tweet", "sharearticle", "share-offsite", "[?&](?:share|sharing)=", "whatsapp://", "mailto:")
SHARE_LABELS = ("^compartilh(?:e|ar|amento)", "^share(?: this| on| via|$)", "^(?:facebook|linkedin|twitter|instagram|whatsapp|youtube)$", r"\b(?:social|share|sharing|linkedin|facebook|twitter|whatsapp)\b")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, position, href, target, label: every anchor in order.

    Native: anchors by pattern, rooted and absolute hrefs resolved against the page.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>.*?</a>"), 0)
    rows = pages.select("page_id", "url", F.posexplode(anchors).alias("position", "anchor"))
    href = F.regexp_extract("anchor", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    label = squeeze(F.regexp_replace(F.regexp_replace("anchor", r"(?s)<[^>]*>", " "), "&nbsp;", " "))
    return rows.select("page_id", "url", "position", href.alias("href"), label.alias("label")).withColumn("target", resolve(F.col("url"), F.col("href")))


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of an href; ``.`` and ``..`` are folded, a lone query or fragment replaces the base's own."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .otherwise(F.concat(site, _folded(whole), rest))
    )


def _folded(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    steps = F.split(F.substring(path, 2, 1 << 30), "/")
    none = F.array().cast("array<string>")
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    open_end = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise("")
    folded = F.aggregate(steps, none, step, lambda done: F.concat(F.lit("/"), F.array_join(done, "/"), F.when(F.size(done) > 0, open_end).otherwise("")))
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def is_share_link(href: Column, target: Column, label: Column) -> Column:
    h, t = F.lower(F.trim(href)), F.lower(target)
    host = host_of(t)
    social = F.exists(F.array(*map(F.lit, SOCIAL)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return h.rlike("^(#|mailto:|tel:|javascript:|whatsapp:)") | social | t.rlike("|".join(SHARE_URLS)) | normalise_words(label).rlike("|".join(SHARE_LABELS))


def same_site(base: Column, target: Column) -> Column:
    """The page's last two host labels appear in the link's host."""
    return F.contains(host_of(target), F.array_join(_last_two(host_of(base)), "."))


def _last_two(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2))


def script_shell(pages: DataFrame) -> DataFrame:
    """Adds ``needs_script``: an empty mount point, or much script with few links and little text."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)
    size = F.aggregate(scripts, F.lit(0), lambda n, s: n + F.length(s)) + 200 * F.regexp_count("html", F.lit(r"(?is)<script[^>]*\ssrc\s*="))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    text = F.length(squeeze(bare))
    links = F.regexp_count("html", F.lit(r"(?is)<a\s[^>]*href"))
    mount = F.col("html").rlike(r"(?is)<(\w+)[^>]*(?:id\s*=\s*[\"'](?:root|app|__next|application)[\"']|data-reactroot)[^>]*>\s*</\1>")
    return pages.withColumns({"script_chars": size, "text_chars": text, "n_links": links}).withColumn("needs_script", mount | ((F.col("n_links") <= 5) & (F.col("script_chars") > F.greatest(F.lit(2000), 2 * F.col("text_chars")))))


def listing_items(pages: DataFrame, css: str | None, title_css: str | None = None, date_css: str | None = None, group: bool = True) -> DataFrame:
    """(page_id, url, html) -> the items of each listing page: page_id, strategy, position, title, url, file, date_text, context, attachments.

    Links of the blocks that ``css`` selects, each address once a page, share links
    left out; a general label takes the link's title, else the block's heading.
    With ``group`` the files of a heading are one item. A page whose blocks give
    fewer than three items is read by all its links of the same site instead, if
    that gives more. An unusable selector selects nothing.
    """
    rows = pages.select("page_id", F.col("url").alias("page"), F.inline(listing_links(css, title_css, date_css)("html")))
    rows = rows.withColumn("url", resolve(F.col("page"), F.col("href")))
    at_home = (F.col("kind") == "selector") | same_site(F.col("page"), F.col("url")) | F.endswith(F.lower("url"), F.lit(".pdf"))
    rows = rows.filter(((F.col("kind") == "scan") | (F.col("href") != "")) & ~is_share_link(F.col("href"), F.col("url"), F.col("label")) & at_home)
    once = Window.partitionBy("page_id", "kind", "url").orderBy("place")
    rows = rows.withColumn("turn", F.row_number().over(once)).filter("turn = 1")
    named = F.get(F.filter("names", lambda n: ~generic_label(n)), F.lit(0))
    rows = rows.withColumn("label", F.when(generic_label(F.col("label")), F.coalesce(named, "label")).otherwise(F.col("label")))
    lead = F.when(F.length("lead") >= 12, F.col("lead"))
    rows = rows.withColumns({"general": generic_label(F.col("label")), "heading": F.coalesce(F.get(F.filter("headers", lambda h: ~generic_label(h)), F.lit(0)), lead, F.lit(""))})
    taken = F.col("general") & (F.col("heading") != "")
    boxed = F.col("container") & (F.col("heading") != "")
    rows = rows.select(
        "page_id",
        "kind",
        F.col("place").alias("position"),
        F.when(taken | boxed, F.col("heading")).otherwise("").alias("header"),
        F.when(taken, F.when(F.length("label") >= 3, F.col("label")).otherwise("")).when(boxed, F.col("label")).otherwise("").alias("label"),
        F.when(taken | (F.col("label") == ""), F.col("heading")).otherwise(F.col("label")).alias("title"),
        "url",
        file_type(F.col("url")).alias("file"),
        "date_text",
        "context",
    ).filter("kind = 'scan' or title <> ''")
    rows = rows if group else rows.withColumn("header", F.lit(""))
    items = group_attachments(rows, ("page_id", "kind"), ("title", "date_text", "context"))
    per_page = Window.partitionBy("page_id")
    found = items.withColumns({k: F.count_if(F.col("kind") == k).over(per_page) for k in ("selector", "scan")})
    chosen = F.when((F.col("selector") < 3) & (F.col("scan") > F.col("selector")), "scan").otherwise("selector")
    title = F.when((F.col("n_links") > 1) & (F.col("header") != ""), F.col("header")).otherwise(F.col("own_title"))
    return found.filter(F.col("kind") == chosen).select("page_id", F.col("kind").alias("strategy"), "position", title.alias("title"), "url", "file", "date_text", "context", "attachments")


def group_attachments(items: DataFrame, by: tuple = (), carried: tuple = ()) -> DataFrame:
    """(position, header, label, url, file) -> one row a header with its principal link and the others as ``attachments``.

    Headers are told apart within ``by``; the principal's ``carried`` columns come
    along (its ``title`` as ``own_title``). A header of 12 or more characters groups; other rows stand alone by url. The
    principal has the best label, shorter ones first, then the earliest.
    """
    head, label = normalise_words(F.col("header")), normalise_words(F.col("label"))
    key = F.when(F.length(head) >= 12, F.concat(F.lit("h:"), head)).otherwise(F.concat(F.lit("u:"), F.col("url")))
    starts = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(label, w))
    score = F.when(starts(cues.SECONDARY_LABELS), -10).otherwise(0) + F.when(contains_any(label, cues.PRINCIPAL_LABELS), 10).otherwise(0) + F.when(F.col("file") == "PDF", 3).when(F.col("file") != "", 1).otherwise(0)
    idle = (F.col("file") == "") & starts(cues.NAVIGATION_LABELS)
    rows = items.withColumns({"key": key, "score": score, "idle": idle, "size": F.length(label)})
    one = F.struct("position", "url", F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("anexo")).alias("label"), "file", "idle")
    grouped = rows.groupBy(*by, "key").agg(F.min("position").alias("position"), F.count("*").alias("n_links"), F.max_by(F.struct("header", "label", "url", "file", *carried), F.struct("score", -F.col("size"), -F.col("position"))).alias("best"), F.sort_array(F.collect_list(one)).alias("all"))
    others = F.filter("all", lambda a: (a["url"] != F.col("best.url")) & ~a["idle"])
    more = [F.col(f"best.{c}").alias("own_title" if c == "title" else c) for c in carried]
    return grouped.select(*by, *(["best.header"] if carried else []), *more, "key", "position", "n_links", F.coalesce(F.when((F.col("n_links") > 1) & (F.col("best.header") != ""), F.col("best.header")), F.col("best.label")).alias("title"), "best.url", "best.file", F.transform(others, lambda a: F.struct(a["url"], a["label"], a["file"])).alias("attachments"))


def walk_pages(pages: DataFrame, most: int) -> DataFrame:
    """(source, page_no, n_new) -> the pages that a walk reads: up to ``most``, stopping before the first gap or page with nothing new."""
    w = Window.partitionBy("source").orderBy("page_no")
    first = Window.partitionBy("source").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("place", F.row_number().over(w) - 1 + F.min("page_no").over(Window.partitionBy("source")))
    stop = (F.col("place") != F.col("page_no")) | (F.col("n_new") == 0)
    rows = rows.withColumn("stop", stop).withColumn("ended", F.coalesce(F.max(F.col("stop").cast("int")).over(first), F.lit(0)) == 1)
    return rows.filter(~F.col("ended") & (F.col("place") == F.col("page_no"))).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most).select("source", "page_no", "n_new")


def is_navigation(title: Column, patterns=cues.NAVIGATION, sections=()) -> Column:
    """Whether a title is a menu entry: empty, one of ``sections``, matched by one of ``patterns``, or run-together menu text.

    Long titles with glued cases are menus unless they are marked or numbered as a call.
    """
    marked = F.coalesce(title.rlike("(?iU)" + cues.OPPORTUNITY_MARKS), F.lit(False))

    def judge(t: Column) -> Column:
        numbered = t.rlike(r"\bn[ºo°]?\s*\d|\b\d{1,3}/\d{4}\b")
        glued = (F.length(t) > 55) & ~marked & ~numbered & (glued_cases(title) >= 1)
        listed = t.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
        return (t == "") | (t.isin(*sections) if sections else F.lit(False)) | listed | glued

    return let(F.lower(squeeze(strip_accents(F.coalesce(title, F.lit(""))))), judge)


def pager_links(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, url, html) -> keys, position, rank, number, target: the links that may lead to a following page.

    rank 0: rel="next"; 1: a link labelled with the page ``number``; 2: a label of the
    next page inside a pager (an element of one of ``PAGER_CLASSES``, or a navigation
    named so); 3: such a label of up to 30 characters anywhere. Only links to the same
    host and to another address are given; targets have no fragment.
    """
    # One pass over the page: anchors, and the tags that open and close pagers around them.
    marks = F.regexp_extract_all("html", F.lit(r"(?is)<(?:a|link)\s[^>]*>(?:[^<]*(?:<(?!/a)[^>]*>[^<]*)*</a>)?|</?(?:nav|div|ul|ol|p|section|span|table|td)\b[^>]*>"), 0)
    pager = "|".join(cues.PAGER_CLASSES)
    opens = rf"(?is)^<\w+\s[^>]*(?:class\s*=\s*[\"'](?:[^\"']*\s)?(?:{pager})(?:\s[^\"']*)?[\"']|class\s*=\s*[\"'][^\"']*(?:pagination|paginacao|pager)|aria-label\s*=\s*[\"'][^\"']*pag)|^<nav\s[^>]*role\s*=\s*[\"']navigation"
    state = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("at"), F.array().cast("array<struct<position:int,anchor:string,inside:boolean>>").alias("found"))

    def step(x: Column, m: Column) -> Column:
        kind = F.when(m.startswith("</"), -1).when(m.rlike(r"^<(?:[aA]|[lL][iI][nN][kK])\s"), 0).otherwise(1)  # what it adds to the depth
        return let(kind, lambda k: moved(x, m, k))

    def moved(x: Column, m: Column, k: Column) -> Column:
        depth = x["depth"] + k
        at = F.when((k == 1) & (x["at"] < 0) & m.rlike(opens), x["depth"]).when((k == -1) & (depth <= x["at"]), -1).otherwise(x["at"])
        one = F.struct(F.size(x["found"]).alias("position"), m.alias("anchor"), (x["at"] >= 0).alias("inside"))
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(k == 0, F.array_append(x["found"], one)).otherwise(x["found"]).alias("found"))

    keys = list(dict.fromkeys([*keys, "url"]))
    rows = settled(pages.select(*keys, F.inline(F.aggregate(marks, state, step)["found"])))
    attribute = lambda name: F.regexp_extract("anchor", rf"(?is)^<\w+\s[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    rows = rows.withColumns({"href": F.trim(attribute("href")), "label": squeeze(F.regexp_replace("anchor", r"(?s)<[^>]*>", " ")), "named": F.concat_ws(" ", attribute("title"), attribute("aria-label"))})
    # Filters stand above the generator, so that what they name is worked out once.
    rows = settled(rows).filter((F.col("href") != "") & ~F.col("href").rlike("(?i)^(#|mailto:|tel:|javascript:)"))
    label, is_link = F.col("label"), F.col("anchor").rlike(r"(?i)^<a\s")
    leads = is_next_label(label) | is_next_label(F.concat_ws(" ", label, "named"))
    number = F.when(is_link & label.rlike("^(?:0|[1-9][0-9]{0,8})$"), label.cast("int"))
    by_label = F.when(is_link & leads, F.when(F.col("inside"), 2).when((label != "") & (F.length("label") <= 30), 3))
    # A number may be the next page's for one page and a label for another.
    ranks = F.array_compact(F.array(F.when(F.col("anchor").rlike(r"(?is)^<\w+\s[^>]*\brel\s*=\s*[\"'][^\"']*next"), 0), F.when(number.isNotNull(), 1), by_label))
    rows = settled(rows.withColumns({"ranks": ranks, "number": number}).drop("anchor", "label", "named", "inside")).filter(F.size("ranks") > 0)
    rows = settled(rows.withColumn("target", F.regexp_replace(resolve(F.col("url"), F.col("href")), "#.*$", "")))
    plain = lambda u: F.regexp_replace(u, "/+$", "")
    rows = rows.filter((host_of(F.col("target")) == host_of(F.col("url"))) & (plain(F.col("target")) != plain(F.col("url"))))
    return rows.select(*keys, "position", F.explode("ranks").alias("rank"), "number", "target")


def next_pages(pages: DataFrame) -> DataFrame:
    """(page_id, page_no, url, html) -> page_id, next_url: the pager link of the least rank, then the first."""
    rows = pager_links(pages, "page_id", "page_no").filter((F.col("rank") != 1) | (F.col("number") == F.col("page_no") + 1))
    return rows.groupBy("page_id").agg(F.min_by("target", F.struct("rank", "position")).alias("next_url"))


def candidate_order(sources: DataFrame, memory: DataFrame) -> DataFrame:
    """(source, urls, ..) x (source, url last good) -> source, .., place, url: the remembered address first, listed or not, each once."""
    joined = sources.join(memory.withColumnRenamed("url", "good"), "source", "left")
    ordered = F.array_distinct(F.array_compact(F.concat(F.array("good"), F.col("urls"))))
    return joined.select(*[c for c in sources.columns if c != "urls"], F.posexplode(ordered).alias("place", "url"))


def first_productive(tried: DataFrame) -> DataFrame:
    """(source, place, url, n_items) -> the url that each source is read by: the first that gives anything."""
    return tried.filter("n_items > 0").groupBy("source").agg(F.min_by("url", "place").alias("url"))


def remember(memory: DataFrame, found: DataFrame) -> DataFrame:
    """The new memory: this run's addresses over the old ones."""
    return memory.withColumnRenamed("url", "old").join(found, "source", "full").select("source", F.coalesce("url", "old").alias("url"))


def suggestions(scored: DataFrame, most: int = 4) -> DataFrame:
    """(source, url, n_calls, score) -> the addresses to try instead, best first, ``most`` a source (a report of fixed length)."""
    w = Window.partitionBy("source").orderBy(F.col("n_calls").desc(), F.col("score").desc(), "url")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def best_per_url(scored: DataFrame) -> DataFrame:
    """(url, label, score) seen on any page -> each url once with its best score and that label, the first by letters on ties."""
    best = scored.groupBy("url").agg(F.max("score").alias("score"), F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("label"))
    return best.filter("score > 0")
