"""Source configuration checks: one row a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import host_of, path_of

SCHEMA = "name string, region string, urls array<string>, root string, selector string, page_kind string, page_parameter string, max_pages int"
REGIONS = ("es", "nacional", "internacional")
PAGE_KINDS = ("auto", "query", "template")
CLOSED_FILTERS = "(?i)[?&](?:filtro=(?:encerradas?|fechadas?|closed|expirado)|status=(?:encerradas?|fechada|closed|3|9))(?:&|$)"


def findings(sources: DataFrame) -> DataFrame:
    """(name, level, rule): errors and warnings of every source, in one scan each over the small table."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    col = F.col
    urls = F.coalesce("urls", F.array().cast("array<string>"))
    any_url = lambda test: F.exists(urls, test)
    query = lambda u: F.regexp_extract(u, r"\?([^#]*)", 1)
    keys = lambda u: F.transform(F.split(query(u), "&"), lambda p: F.substring_index(p, "=", 1))
    hosts = F.transform(urls, host_of)
    rows = sources.withColumn("twins", F.count("*").over(Window.partitionBy("name")))
    rules = [
        ("error", "name missing", blank(col("name"))),
        ("error", "region missing", blank(col("region"))),
        ("error", "urls missing", F.size(urls) == 0),
        ("error", "name repeated", col("twins") > 1),
        ("error", "region invalid", ~blank(col("region")) & ~col("region").isin(*REGIONS)),
        ("error", "url empty", any_url(blank)),
        ("error", "url without scheme", any_url(lambda u: ~blank(u) & ~u.rlike("^https?://"))),
        ("warning", "filter in path", any_url(lambda u: F.contains(path_of(u), F.lit("=")) & (query(u) == ""))),
        ("warning", "parameter repeated", any_url(lambda u: (query(u) != "") & (F.size(keys(u)) > F.size(F.array_distinct(keys(u)))))),
        ("warning", "closed calls only", any_url(lambda u: u.rlike(CLOSED_FILTERS))),
        ("warning", "root missing", blank(col("root"))),
        ("error", "root without scheme", ~blank(col("root")) & ~col("root").rlike("^https?://")),
        ("error", "root of another site", ~blank(col("root")) & (F.size(urls) > 0) & ~F.array_contains(hosts, F.when(col("root").rlike("://"), host_of(col("root"))).otherwise(host_of(F.concat(F.lit("https://"), col("root")))))),
        ("warning", "selector missing", blank(col("selector"))),
        ("error", "page kind invalid", ~blank(col("page_kind")) & ~col("page_kind").isin(*PAGE_KINDS)),
        ("error", "template without marker", (col("page_kind") == "template") & ~any_url(lambda u: F.contains(u, F.lit("{pagina}")))),
        ("error", "query without parameter", (col("page_kind") == "query") & blank(col("page_parameter"))),
        ("warning", "many pages", col("max_pages") > 25),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rule, test in rules]))
    return rows.select("name", F.inline(found))


def fixed(sources: DataFrame) -> DataFrame:
    """The safe corrections: schemes added, a root of another site replaced by the first candidate's that has a host.

    ``fixes`` names what was changed; rows without it are as they were. The corrected
    table is a new one, the old one stays as the backup (``storage.swap_in``).
    """
    urls = F.transform("urls", lambda u: F.when((F.trim(u) != "") & ~u.rlike("^https?://"), F.concat(F.lit("https://"), u)).otherwise(u))
    rows = sources.withColumns({"urls": urls, "__urls": F.col("urls"), "__root": F.col("root")})
    root = F.when(F.coalesce("root", F.lit("")) == "", F.col("root")).when(F.col("root").rlike("^https?://"), F.col("root")).otherwise(F.concat(F.lit("https://"), F.col("root")))
    hosts = F.filter(F.transform("urls", host_of), lambda h: h != "")
    rows = rows.withColumn("root", F.when((F.size(hosts) > 0) & ~F.array_contains(hosts, host_of(root)) & (F.coalesce("root", F.lit("")) != ""), F.concat(F.lit("https://"), F.get(hosts, F.lit(0)))).otherwise(root))
    changed = lambda c, name: F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(name))
    return rows.withColumn("fixes", F.array_compact(F.array(changed("urls", "scheme of a url"), changed("root", "root")))).drop("__urls", "__root")
