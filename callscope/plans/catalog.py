"""Query name -> builder and oracle SQL, over the driver's tables and the derived fixtures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions import cues, dates
from callscope.functions import text as T
from callscope.operators import discovery, entity, extraction, history, ledger, lint, panel, scoring, search, terms, walk
from callscope.operators import lexicon as L
from callscope.plans import collect
from callscope.sources import fixtures as X
from callscope.sources import html, site, storage
from callscope.sources.fixtures import AS_OF, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(lower(strip_accents({x})), 'º', 'o'), 'ª', 'a'), '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_norm(x)}, '[^\w\sß]', ' ', 'g'), '\s+', ' ', 'g'))"


def _has(x: str, terms) -> str:
    return f"regexp_matches({x}, '{'|'.join(map(re.escape, terms)).replace(chr(92) + ' ', ' ')}')" if terms else "false"


CALLS = f"calls AS ({X.CALLS_SQL})"
DAY = f"DATE '{AS_OF}'"
FOUND = "CASE WHEN v IN (5, 7) THEN NULL ELSE deadline END"
STATUS = f"CASE WHEN v = 5 THEN 'encerrado' WHEN v = 7 THEN 'aberto' WHEN deadline < {DAY} THEN 'encerrado' WHEN v = 6 THEN 'futuro' ELSE 'aberto' END"


# Deadlines and status


@query(f"WITH {CALLS} SELECT call_id, {FOUND} AS found, CASE WHEN v IN (0, 2, 3, 4) THEN 24 WHEN v IN (1, 6) THEN 21 END AS score FROM calls")
def deadline_extract(spark: SparkSession, d: str) -> DataFrame:
    return dates.with_deadline(X.calls(spark, d), "text").select("call_id", F.col("best.day").alias("found"), F.col("best.score").alias("score"))


@query(f"""WITH {CALLS} SELECT call_id, {STATUS} AS status, {FOUND} AS deadline, strftime({FOUND}, '%d/%m/%Y') AS deadline_text,
  CAST(date_diff('day', {DAY}, {FOUND}) AS INTEGER) AS days_left, CASE v WHEN 5 THEN 80 WHEN 7 THEN 65 ELSE 100 END AS confidence,
  CASE WHEN v = 5 THEN 'page tells of results or of the end' WHEN v = 7 THEN 'page says that applications are open' WHEN deadline < {DAY} THEN 'deadline passed on ' || strftime(deadline, '%d/%m/%Y')
    WHEN v = 6 THEN 'announced, not open yet' ELSE 'deadline confirmed: ' || strftime(deadline, '%d/%m/%Y') END AS status_reason FROM calls""")
def deadline_status(spark, d):
    rows = dates.with_status(X.calls(spark, d).drop("deadline"), "text", AS_OF)
    return rows.select("call_id", "status", "deadline", "deadline_text", "days_left", "confidence", "status_reason")


@query(f"""WITH {CALLS}, s AS (SELECT call_id AS id, {STATUS} AS status, date_diff('day', {DAY}, {FOUND}) AS days FROM calls)
SELECT count(*) FILTER (status = 'aberto') AS n_open, count(*) FILTER (status = 'aberto' AND id % 60 >= 30) AS n_recommended, count(*) FILTER (status = 'aberto' AND days BETWEEN 0 AND 14) AS n_urgent,
  count(*) FILTER (status = 'verificar') AS n_check, count(*) AS n_total FROM s""")
def status_kpis(spark, d):
    rows = dates.with_status(X.calls(spark, d).drop("deadline"), "text", AS_OF).withColumn("priority", (F.col("call_id") % 60).cast("double"))
    return panel.kpis(rows)


@query(f"""WITH {CALLS}, c AS (SELECT call_id, CASE WHEN v = 7 THEN NULL ELSE deadline END AS dl, {DAY} - CAST(call_id % 20 AS INTEGER) AS seen FROM calls)
SELECT call_id, CASE WHEN dl < {DAY} THEN 'encerrado' WHEN dl IS NULL AND seen < {DAY} - 7 THEN 'verificar' ELSE 'aberto' END AS status FROM c""")
def status_aging(spark, d):
    day = F.lit(AS_OF).cast("date")
    rows = X.calls(spark, d).select("call_id", F.when(F.col("v") != 7, F.col("deadline")).alias("dl"), F.date_sub(day, (F.col("call_id") % 20).cast("int")).alias("seen"))
    return rows.select("call_id", dates.refreshed_status(F.lit("aberto"), F.col("dl"), F.col("seen"), day).alias("status"))


@query(f"""WITH {CALLS}, s AS (SELECT {STATUS} AS status, date_diff('day', {DAY}, {FOUND}) AS n FROM calls),
u AS (SELECT CASE WHEN status = 'aberto' AND n = 0 THEN 'today' WHEN status = 'aberto' AND n = 1 THEN 'tomorrow' WHEN status = 'aberto' AND n BETWEEN 2 AND 7 THEN 'urgent'
  WHEN status = 'aberto' AND n BETWEEN 8 AND 14 THEN 'soon' WHEN status = 'aberto' AND n > 14 THEN 'later' WHEN status = 'verificar' THEN 'confirm' WHEN n < 0 THEN 'ended' ELSE '' END AS bucket FROM s)
SELECT bucket, count(*) AS n FROM u GROUP BY bucket""")
def urgency_buckets(spark, d):
    rows = dates.with_status(X.calls(spark, d).drop("deadline"), "text", AS_OF)
    return rows.groupBy(dates.urgency(F.col("status"), F.col("days_left")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS} SELECT call_id, CAST(strpos(text, CASE WHEN v = 1 THEN strftime(deadline, '%Y-%m-%d') WHEN v = 2 THEN 'ate ' WHEN v = 3 THEN 'by ' ELSE strftime(deadline, '%d/%m/%Y') END)
    + CASE v WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE -1 END AS INTEGER) AS start, deadline AS day FROM calls WHERE v <> 7
UNION ALL SELECT call_id, CAST(strpos(text, strftime(deadline - 60, '%d/%m/%Y')) - 1 AS INTEGER), deadline - 60 FROM calls WHERE v = 4""")
def all_dates_explode(spark, d):
    return dates.with_dates(X.calls(spark, d).select("call_id", "text"), "text").select("call_id", F.inline("dates")).select("call_id", "start", "day")


# Text functions


@query(f"SELECT doc_id, md5({_norm('text')}) AS a, md5(strip_accents(text)) AS plain FROM documents")
def normalize_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("plain"))
    return rows.select("doc_id", F.md5(T.folded(F.col("plain"))).alias("a"), F.md5("plain").alias("plain"))


#: Titles in several scripts and their normal forms; ``{n}`` is a row's number.
_SCRIPTS = (
    ("Edital № {n}", "edital no {n}"), ("Θέση Ερευνητή {n}", "θεση ερευνητη {n}"), ("Йошкар-Ола, конкурс {n}", "иошкар-ола, конкурс {n}"), ("Ｅｄｉｔａｌ　{n}", "edital {n}"), ("Chamada … {n}", "chamada ... {n}"),
    ("½ bolsa ①", "1⁄2 bolsa 1"), ("ﬁnanciamento ﬃ {n}", "financiamento ffi {n}"), ("Ação nº {n}ª", "acao no {n}a"), ("한국 {n}", "\u1112\u1161\u11ab\u1100\u116e\u11a8 {n}"), ("㌀ {n}", "アハート {n}"), ("Grant {n}", "grant {n}"),
)


@query("SELECT p_partkey AS id, replace([" + ", ".join(f"'{t}'" for _, t in _SCRIPTS) + f"][CAST(p_partkey % {len(_SCRIPTS)} + 1 AS BIGINT)], '{{n}}', CAST(p_partkey AS VARCHAR)) AS title FROM part")
def normalize_scripts(spark, d):
    """Ligatures, Greek, Cyrillic, wide and numbered forms, Hangul and squared words."""
    title = F.element_at(F.array(*[F.lit(t) for t, _ in _SCRIPTS]), (F.col("p_partkey") % len(_SCRIPTS) + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(title, F.lit("{n}"), F.col("p_partkey").cast("string")).alias("title"))
    return rows.select("id", T.normalise(F.col("title")).alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[a-zà-ÿ][A-ZÀ-Þ]'))::INTEGER AS n FROM documents")
def glued_case_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.glued_cases(F.col("text")).alias("n"))


_FIRST = "split_part(text, chr(10), 1)"


def _cut_sql() -> str:
    """The title rules in DuckDB's regular expressions, rule by rule."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    t = "title"
    for p in T._TECHNICAL:
        t = f"regexp_replace({t}, {quoted(p)}, ' ', 'g')"
    steps = [f"a AS (SELECT id, trim(regexp_replace({t}, '\\s+', ' ', 'g')) AS t FROM titles)"]
    t = "t"
    for p in cues.TITLE_PREFIXES:
        t = f"trim(regexp_replace({t}, {quoted('(?i)' + p)}, ''))"
    steps.append(f"b AS (SELECT id, {t} AS t FROM a)")
    cases = " ".join(f"WHEN regexp_matches(t, {quoted('(?i)' + p)}) AND length(regexp_extract(t, {quoted('(?is)^(.*?)' + p)}, 1)) >= 12 THEN trim(regexp_extract(t, {quoted('(?is)^(.*?)' + p)}, 1))" for p in cues.BODY_CUES)
    steps.append(f"c AS (SELECT id, CASE {cases} ELSE t END AS t FROM b)")
    place = lambda sep: f"CASE WHEN contains(w, '{sep}') THEN 110 - strpos(reverse(w), '{sep[::-1]}') - {len(sep) - 1} ELSE -1 END"
    cases = " ".join(f"WHEN {place(x)} > 40 THEN trim(left(w, {place(x)}))" for x in T.SEPARATORS)
    steps.append(f"d AS (SELECT id, t, CASE WHEN length(t) > 110 THEN CASE {cases} ELSE trim(w) END ELSE t END AS u FROM (SELECT *, left(t, 110) AS w FROM c))")
    return f"WITH titles AS ({X.TITLES_SQL}), " + ", ".join(steps) + " SELECT id, regexp_replace(u, '[ .,;:\\-–—|]+$', '') AS title FROM d"


@query(_cut_sql())
def clean_title(spark, d):
    return X.titles(spark, d).select("id", T.clean_title(F.col("title")).alias("title"))


_TITLES = f"titles AS (WITH {CALLS} SELECT call_id, concat('Chamada ', source_no, ' cooperacao ', year(deadline)) AS title, concat('https://www.site', source_no, '.org/editais/chamada-', call_id, '_', year(deadline), '.pdf') AS url FROM calls)"


def _titles(spark, d):
    year = F.year("deadline").cast("string")
    return X.calls(spark, d).select("call_id", F.concat(F.lit("Chamada "), "source_no", F.lit(" cooperacao "), year).alias("title"), F.concat(F.lit("https://www.site"), "source_no", F.lit(".org/editais/chamada-"), "call_id", F.lit("_"), year, F.lit(".pdf")).alias("url"))


@query(f"WITH {_TITLES} SELECT call_id, CAST(right(title, 4) AS INTEGER) AS year, CAST(right(title, 4) AS INTEGER) < 2026 AS stale FROM titles")
def stale_edition(spark, d):
    return _titles(spark, d).select("call_id", T.year_of(F.col("title")).alias("year"), T.stale_edition(F.col("title"), F.lit(""), 2026).alias("stale"))


@query(f"WITH {_TITLES} SELECT call_id, 'site' || regexp_extract(url, 'site(\\d+)', 1) || '.org' AS host, 'PDF' AS file, 'chamada ' || call_id || ' ' || right(title, 4) AS slug FROM titles")
def url_parts(spark, d):
    u = F.col("url")
    return _titles(spark, d).select("call_id", T.host_of(u).alias("host"), T.file_type(u).alias("file"), T.slug_title(u).alias("slug"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host,
  split_part(split_part(url, '#', 1), '?', 1) || '?' || array_to_string(list_append(list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) <> 'page'), 'page=3'), '&') AS third
FROM pages""")
def page_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.host_of(F.col("url")).alias("host"), T.page_url(F.col("url"), F.lit(3)).alias("third"))


# Classification


def _pattern(words) -> str:
    return "|".join(T.prefix_pattern(w) for w in words).replace("\\ ", " ")


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(n, '{_pattern(t.words)}') THEN '{t.key}' END" for t in L.THEMES) + "], lambda x: x IS NOT NULL)"
_DOC_STATUS = "CASE " + " ".join(f"WHEN regexp_matches(n, '{_pattern(words)}') THEN '{key}'" for key, words in L.DOC_STATUS) + " ELSE 'aberto' END"
_POINTS = "(" + " + ".join(f"CASE WHEN list_contains(tags, '{t.key}') THEN {({1: 10, 2: 4, 3: 2}[t.priority])} ELSE 0 END" for t in L.THEMES) + """
  + CASE WHEN list_contains(tags, 'internacional') THEN 8 ELSE 0 END + CASE WHEN list_contains(tags, 'cotutela') THEN 6 ELSE 0 END + CASE WHEN list_contains(tags, 'mobilidade') THEN 4 ELSE 0 END
  + CASE WHEN list_contains(tags, 'internacional') AND (list_contains(tags, 'mobilidade') OR list_contains(tags, 'cotutela')) THEN 6 ELSE 0 END)"""


@query(f"""WITH {CALLS}, n AS (SELECT call_id, {_words('text')} AS n FROM calls), t AS (SELECT call_id, {_TAGS} AS tags, {_DOC_STATUS} AS doc_status FROM n), p AS (SELECT *, {_POINTS} AS p FROM t)
SELECT call_id, array_to_string(tags, ',') AS tags, doc_status, CAST(CASE doc_status WHEN 'resultado' THEN greatest(1, floor(p * 0.45)) WHEN 'retificacao' THEN greatest(1, floor(p * 0.7)) WHEN 'encerrado' THEN greatest(1, floor(p * 0.25)) ELSE p END AS INTEGER) AS points FROM p""")
def theme_points(spark, d):
    rows = X.calls(spark, d).withColumn("n", T.normalise_words(F.col("text"))).withColumns({"tags": scoring.theme_tags(F.col("n")), "doc_status": scoring.document_status(F.col("n"))})
    return rows.select("call_id", F.array_join("tags", ",").alias("tags"), "doc_status", scoring.theme_points(F.col("tags"), F.col("doc_status")).cast("int").alias("points"))


_HITS = "concat_ws(';', " + ", ".join(f"CASE WHEN {_has('n', a.terms)} THEN '{a.key}=' || array_to_string(list_slice(list_filter([{', '.join(repr(t) for t in a.terms)}], lambda t: contains(n, t)), 1, 5), ',') END" for a in L.PROFILE.ranked) + ")"


@query(f"""WITH {CALLS}, n AS (SELECT 'c' AS kind, call_id AS id, {_norm('text')} AS n FROM calls UNION ALL SELECT 'd', doc_id, {_norm('text')} FROM documents)
SELECT kind, id, {_HITS} AS hits FROM n WHERE {_HITS} <> ''""")
def axis_hits(spark, d):
    rows = X.calls(spark, d).select(F.lit("c").alias("kind"), F.col("call_id").alias("id"), "text").unionByName(table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"))
    rows = rows.withColumn("n", T.normalise(F.col("text")))
    hits = F.array_join(F.transform(scoring.axis_hits(F.col("n"), L.PROFILE), lambda a: F.concat(a["key"], F.lit("="), F.array_join(a["hits"], ","))), ";")
    return dates.settled(rows.select("kind", "id", hits.alias("hits"))).filter("hits <> ''")


@query(ORACLE_SQL["axis_hits"])
def axis_hits_by_table(spark, d):
    """The axes' terms as one automaton: the rows of ``axis_hits`` whatever the table's size."""
    rows = X.calls(spark, d).select(F.lit("c").alias("kind"), F.col("call_id").alias("id"), "text").unionByName(table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"))
    found = rows.select("kind", "id", terms.axis_hits(T.normalise(F.col("text")), L.PROFILE).alias("axes"))
    hits = F.array_join(F.transform("axes", lambda a: F.concat(a["key"], F.lit("="), F.array_join(a["hits"], ","))), ";")
    return found.select("kind", "id", hits.alias("hits")).filter("hits <> ''")


_TERMS = f"t AS (SELECT DISTINCT unnest(string_split({_words('text')}, ' ')) AS term FROM benchmark), terms AS (SELECT CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS term_id, term FROM t WHERE term <> '')"


@query(f"WITH {_TERMS}, n AS (SELECT doc_id, {_norm('text')} AS n FROM documents) SELECT doc_id, count(*) AS n_terms, sum(term_id)::BIGINT AS ids FROM n JOIN terms ON contains(n, term) GROUP BY doc_id")
def large_lexicon(spark, d):
    """Every word of the benchmark's passages as a term, found in every document."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(T.normalise_words(F.col("text")), " ")).alias("term")).filter("term <> ''").distinct()
    # The rule table is numbered in one task, as tables of rules are.
    numbered = words.select(F.row_number().over(Window.orderBy("term")).cast("long").alias("term_id"), "term")
    found = terms.with_terms(table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("n")), "n", storage.kept(numbered, "terms"))
    return found.filter(F.size("term_ids") > 0).select("doc_id", F.size("term_ids").cast("long").alias("n_terms"), F.aggregate("term_ids", F.lit(0).cast("long"), lambda n, x: n + x).alias("ids"))


@query(f"WITH {CALLS}, n AS (SELECT 'c' AS kind, call_id AS id, {_words('text')} AS n FROM calls UNION ALL SELECT 'd', doc_id, {_words('text')} FROM documents), t AS (SELECT kind, id, {_TAGS} AS tags FROM n) SELECT kind, id, array_to_string(tags, ',') AS tags FROM t WHERE len(tags) > 0")
def theme_tags_by_table(spark, d):
    rows = X.calls(spark, d).select(F.lit("c").alias("kind"), F.col("call_id").alias("id"), "text").unionByName(table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"))
    found = rows.select("kind", "id", F.array_join(terms.theme_tags(T.normalise_words(F.col("text"))), ",").alias("tags"))
    return found.filter("tags <> ''")


_WEIGHT = "CASE " + " ".join(f"WHEN {_has('n', a.terms)} THEN {a.weight}" for a in L.PROFILE.ranked) + " ELSE 0 END"
_N_AXES = "(" + " + ".join(f"CAST({_has('n', a.terms)} AS INTEGER)" for a in L.PROFILE.axes) + ")"
_PRE = f"""{_WEIGHT} + least(8, 3 * greatest({_N_AXES} - 1, 0)) + CASE WHEN {_has('n', L.PROFILE.international)} THEN 18 ELSE 0 END + CASE WHEN {_has('n', L.PROFILE.funding)} THEN 10 ELSE 0 END
 + CASE WHEN {_has('n', L.PROFILE.opportunity)} THEN 8 ELSE 0 END + CASE WHEN {_has('n', L.PROFILE.priority_places)} THEN 5 ELSE 0 END - CASE WHEN {_has('n', cues.CLOSED)} OR {_has('n', cues.RESULT)} THEN 35 ELSE 0 END"""


@query(f"""WITH {CALLS}, n AS (SELECT call_id, source_no, {_norm('text')} AS n FROM calls), p AS (SELECT call_id, source_no, n, {_PRE} AS pre FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY pre DESC, call_id) AS place FROM p WHERE pre >= 8 OR {_N_AXES} > 0) SELECT call_id, source_no, CAST(pre AS INTEGER) AS pre, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def prequalify_topk(spark, d):
    """The reading budget: the ten best candidates of each source."""
    rows = X.calls(spark, d).withColumn("n", T.normalise(F.col("text"))).withColumn("axes", scoring.axis_hits(F.col("n"), L.PROFILE))
    rows = rows.withColumn("pre", scoring.prequalify_score(F.col("n"), F.col("axes"), L.PROFILE))
    # The verdict is ranked first and filtered after the window, so that no pushed-down filter works the scores out twice.
    rows = rows.withColumn("fit", scoring.prequalified(F.col("n"), F.col("pre"), F.col("axes"), L.PROFILE))
    w = Window.partitionBy("source_no").orderBy(F.col("fit").desc(), F.col("pre").desc(), "call_id")
    return rows.withColumn("place", F.row_number().over(w)).filter("fit and place <= 10").select("call_id", "source_no", F.col("pre").cast("int").alias("pre"), "place")


_INTL = _has("n", L.PROFILE.strong)
_EVAL = f"""WITH {CALLS}, n AS (SELECT call_id, source_no, v, {_norm('text')} AS n, {STATUS} AS status, {FOUND} AS dl FROM calls),
e AS (SELECT *, {_INTL} AS intl, ({_has('n', L.PROFILE.opportunity)} OR dl IS NOT NULL) AS opp, {_N_AXES} AS axes,
  least(100, greatest(0, {_WEIGHT} + least(10, 5 * greatest({_N_AXES} - 1, 0)) + CASE WHEN {_INTL} THEN 12 ELSE 0 END + CASE WHEN {_has('n', L.PROFILE.funding)} THEN 8 ELSE 0 END
  + CASE WHEN {_has('n', L.PROFILE.opportunity)} OR dl IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN {_has('n', L.PROFILE.priority_places)} THEN 4 ELSE 0 END + CASE WHEN {_has('n', L.PROFILE.priority_areas)} THEN 2 ELSE 0 END)) AS score FROM n),
g AS (SELECT *, axes > 0 AND intl AND opp AND score >= 30 AS relevant FROM e)"""


_LABELLED = "list_filter([" + ", ".join(f"CASE WHEN {_has('n', a.terms)} THEN '{a.label}' END" for a in L.PROFILE.ranked) + "], lambda x: x IS NOT NULL)"


@query(_EVAL + f""" SELECT call_id, status, CAST(score AS INTEGER) AS score, relevant, relevant AND status = 'aberto' AS active, array_to_string(list_filter([CASE WHEN axes > 0 THEN array_to_string({_LABELLED}[1:2], ' / ') END,
  CASE WHEN intl THEN 'international' END, CASE WHEN {_has('n', L.PROFILE.funding)} THEN 'funding or fellowship' END, 'deadline ' || strftime(dl, '%d/%m/%Y')], lambda x: x IS NOT NULL), ' | ') AS reason FROM g""")
def evaluate_calls(spark, d):
    rows = scoring.evaluate(X.calls(spark, d).drop("deadline"), "text", AS_OF)
    return rows.select("call_id", "status", F.col("score").cast("int").alias("score"), "relevant", "active", F.col("relevance_reason").alias("reason"))


@query(_EVAL + " SELECT CASE WHEN NOT relevant THEN 'not relevant' WHEN status <> 'aberto' THEN 'status ' || status WHEN dl IS NULL THEN 'no confirmed deadline' ELSE 'accepted' END AS reason, count(*) AS n FROM g GROUP BY 1")
def reject_reasons(spark, d):
    rows = scoring.evaluate(X.calls(spark, d).drop("deadline"), "text", AS_OF)
    return rows.groupBy(F.coalesce(scoring.reject_reason(need_date=F.lit(True)), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


_RESTR = """r AS (SELECT call_id, source_no, n, status, score, dl, contains(n, 'joint research') AS fav, contains(n, 'mobilidade academica') AS att, contains(n, 'forthcoming') AS blk FROM g)"""


@query(_EVAL + ", " + _RESTR + " SELECT call_id, CASE WHEN blk THEN 'restricao_conhecida' WHEN fav THEN 'via_individual' WHEN att THEN 'verificar' ELSE 'sem_catalogo' END AS eligibility, CAST(blk AS INTEGER) + CAST(fav AS INTEGER) + CAST(att AS INTEGER) AS n FROM r")
def restrictions(spark, d):
    rows = X.calls(spark, d).withColumn("r", scoring.restrictions(F.col("text"), F.lit("")))
    return rows.select("call_id", scoring.eligibility(F.col("r")).alias("eligibility"), F.size("r").alias("n"))


@query(_EVAL + ", " + _RESTR + """, p AS (SELECT call_id, score * CASE source_no WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.2::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN blk THEN 0.2::DOUBLE WHEN fav THEN 1.4::DOUBLE WHEN att THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END
  * CASE status WHEN 'encerrado' THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END AS x FROM r)
SELECT call_id, CAST(floor(round(x, 1) + 0.0001) AS INTEGER) AS whole, CASE WHEN x >= 44.95 THEN 'very high' WHEN x >= 29.95 THEN 'high' WHEN x >= 19.95 THEN 'medium' ELSE 'complementary' END AS fit FROM p""")
def priority_ranking(spark, d):
    weights = spark.createDataFrame(list(L.SOURCE_WEIGHTS.items()), "source_no long, weight double")
    rows = scoring.evaluate(X.calls(spark, d).drop("deadline"), "text", AS_OF).withColumn("r", scoring.restrictions(F.col("text"), F.lit("")))
    rows = rows.join(F.broadcast(weights), "source_no", "left").withColumn("priority", scoring.priority(F.col("score"), F.col("weight"), F.col("r"), F.col("status")))
    return rows.select("call_id", F.floor(F.col("priority") + 0.0001).cast("int").alias("whole"), scoring.fit_label(F.col("priority")).alias("fit"))


@query(_EVAL + f" SELECT call_id, {_has('n', cues.LOCAL)} AS local, relevant AND {_has('n', cues.LOCAL)} AS relevant FROM g")
def local_connection(spark, d):
    """Calls that must name a local connection to be relevant."""
    texts = X.calls(spark, d).drop("deadline").withColumn("text", F.when(F.col("call_id") % 2 == 0, F.concat(F.lit("Pesquisadores do Brasil. "), "text")).otherwise(F.col("text")))
    rows = scoring.evaluate(texts, "text", AS_OF, need_local=F.lit(True))
    return rows.select("call_id", "local", "relevant")


ORACLE_SQL["local_connection"] = ORACLE_SQL["local_connection"].replace(f"{_norm('text')} AS n", f"{_norm("CASE WHEN call_id % 2 = 0 THEN concat('Pesquisadores do Brasil. ', text) ELSE text END")} AS n")

_MERGED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{k}' END" for k, test in {
    t.key: " OR ".join([f"list_contains(tags, '{t.key}')", *[_has("n", a.terms) for a in L.PROFILE.axes if t.key in a.themes], *(["intl"] if t.key == "internacional" else []), *([_has("n", L.PROFILE.funding)] if t.key == "bolsas" else [])]) for t in sorted(L.THEMES, key=lambda t: t.priority)
}.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(_EVAL.replace("n AS (SELECT call_id,", f"n AS (SELECT call_id, {_words('text')} AS w,") + f", t AS (SELECT *, {_TAGS.replace('(n,', '(w,')} AS tags FROM g) SELECT call_id, {_MERGED} AS themes FROM t")
def merged_themes(spark, d):
    """Themes found by words and those that the axes suggest, in the order of the theme table."""
    rows = scoring.evaluate(X.calls(spark, d).drop("deadline"), "text", AS_OF)
    tags = scoring.text_tags(F.col("text"))
    return rows.select("call_id", F.array_join(scoring.merged_themes(tags, F.col("themes")), ",").alias("themes"))


@query("SELECT p_partkey AS id, p_partkey % 3 = 0 AS public_only, CASE WHEN p_partkey % 3 = 0 THEN 'restricao_conhecida' WHEN p_partkey % 3 = 1 THEN 'via_individual' ELSE 'sem_catalogo' END AS eligibility FROM part")
def public_only(spark, d):
    """A text that limits a call to public institutions blocks it, whatever else the catalogue says."""
    said = F.element_at(F.array(*map(F.lit, ("Joint research call. Somente instituições públicas podem participar", "Joint research call para todas as instituições públicas e privadas", "Aberto a todos"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = scoring.evaluate(table(spark, d, "part").select(F.col("p_partkey").alias("id"), said.alias("text")), "text", AS_OF)
    found = scoring.with_public_only(scoring.restrictions(F.col("text"), F.lit("")), F.col("public_only"))
    return rows.select("id", "public_only", scoring.eligibility(found).alias("eligibility"))


_CLASS_TEXT = f"concat_ws(' ', {_words('title')}, {_words("'chamada ' || call_id || ' ' || right(title, 4)")}, {_words("replace(replace(url, '-', ' '), '/', ' ')")}, {_words('text')})"


@query(f"""WITH {CALLS}, {_TITLES}, x AS (SELECT call_id, {_CLASS_TEXT} AS n FROM titles JOIN calls USING (call_id)), t AS (SELECT call_id, {_TAGS} AS tags, {_DOC_STATUS} AS doc_status FROM x), p AS (SELECT *, {_POINTS} AS p FROM t WHERE len(tags) > 0)
SELECT call_id, array_to_string(tags, ',') AS tags, doc_status, CAST(CASE doc_status WHEN 'resultado' THEN greatest(1, floor(p * 0.45)) WHEN 'retificacao' THEN greatest(1, floor(p * 0.7)) WHEN 'encerrado' THEN greatest(1, floor(p * 0.25)) ELSE p END AS INTEGER) AS points FROM p""")
def classified_calls(spark, d):
    """Links by title, slug, address and text; those without a theme are left out."""
    rows = _titles(spark, d).join(X.calls(spark, d).select("call_id", "text"), "call_id")
    found = dates.settled(rows.select("call_id", scoring.classified(F.col("title"), F.col("url"), F.col("text")).alias("c"))).filter("c is not null")
    return found.select("call_id", F.array_join("c.tags", ",").alias("tags"), F.col("c.status").alias("doc_status"), F.col("c.points").cast("int").alias("points"))


_AUDIENCE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has('n', terms)} THEN '{k}' END" for k, terms in L.PROFILE.audiences.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {CALLS}, n AS (SELECT call_id, {_norm('text')} AS n FROM calls) SELECT call_id, {_AUDIENCE} AS audience FROM n")
def call_audience(spark, d):
    return scoring.evaluate(X.calls(spark, d).drop("deadline"), "text", AS_OF).select("call_id", F.array_join("audience", ",").alias("audience"))


_NEAR = "|".join(map(re.escape, cues.ANCHORS)).replace("\\ ", " ")
_REASON = "CASE " + " ".join([f"WHEN contains(n, '{t}') THEN 'explicit: {t}'" for t in L.PROFILE.strong] + [f"WHEN regexp_matches(n, '(?s)(?:{_NEAR}).{{0,450}}{p}|{p}.{{0,450}}(?:{_NEAR})') THEN 'place: {p}'" for p in L.PROFILE.places]) + " END"


@query(f"""WITH {CALLS}, n AS (SELECT 'c' AS kind, call_id AS id, {_norm('text')} AS n FROM calls UNION ALL SELECT 'd', doc_id, {_norm('text')} FROM documents) SELECT kind, id, {_REASON} AS reason FROM n WHERE {_REASON} IS NOT NULL""")
def international_reason(spark, d):
    """Why a text counts as international: an explicit term, or a place near an anchor word."""
    rows = X.calls(spark, d).select(F.lit("c").alias("kind"), F.col("call_id").alias("id"), "text").unionByName(table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"))
    rows = dates.settled(rows.select("kind", "id", T.normalise(F.col("text")).alias("n")))
    return dates.settled(rows.select("kind", "id", scoring.international_reason(F.col("n"), L.PROFILE).alias("reason"))).filter("reason is not null")


@query("SELECT o_orderkey AS id, 'Edital 202' || o_orderkey % 10 || ' e 2019' AS title, greatest(2019, 2020 + o_orderkey % 10)::INTEGER AS year FROM orders")
def mended_year(spark, d):
    broken = F.concat(F.lit("Edital 202 "), F.col("o_orderkey") % 10, F.lit(" e 2019"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.mend_year(broken).alias("title"))
    return rows.withColumn("year", T.year_of(F.col("title")))


@query("""WITH s AS (SELECT 'u' || l_partkey AS url, l_linestatus || l_returnflag AS label, CAST(l_quantity AS INTEGER) - 30 AS score FROM lineitem)
SELECT url, max(score) AS score, arg_min(label, -score * 1000 + ascii(label) * 3 + ascii(label[2])) AS label FROM s GROUP BY url HAVING max(score) > 0""")
def best_link(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("u"), "l_partkey").alias("url"), F.concat("l_linestatus", "l_returnflag").alias("label"), (F.col("l_quantity").cast("int") - 30).alias("score"))
    return extraction.best_per_url(rows)


# Entity resolution


@query(f"WITH {_TITLES} SELECT call_id, right(title, 4) || ' cooperacao' AS signature FROM titles")
def signature(spark, d):
    return _titles(spark, d).select("call_id", T.signature(F.col("title")).alias("signature"))


_SETS = f"""s AS (SELECT min(doc_id) AS id, toks FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({_words(_FIRST)}, ' '),
  lambda w: NOT list_contains([{', '.join(repr(w) for w in dict.fromkeys(cues.EMPTY_WORDS))}], w) AND CASE WHEN regexp_matches(w, '^[0-9]+$') THEN regexp_matches(w, '^20[0-9][0-9]$') ELSE length(w) > 2 END))) AS toks FROM documents)
  WHERE len(toks) > 0 GROUP BY toks)"""
_PAIRS = f"WITH {_SETS}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.toks, b.toks)) AS i, len(a.toks) + len(b.toks) AS n FROM s a JOIN s b ON a.id < b.id AND len(a.toks) <= 2 * len(b.toks) AND len(b.toks) <= 2 * len(a.toks))"


def _first_lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.substring_index("text", "\n", 1).alias("title"))


@query(_PAIRS + " SELECT a, b, round(i / (n - i), 6) AS similarity FROM p WHERE i >= 0.7 * (n - i)")
def pair_similarity(spark, d):
    rows = entity.tokenised(_first_lines(spark, d), "title").filter(F.size("tokens") > 0)
    sets = rows.groupBy("tokens").agg(F.min("position").alias("set_id")).withColumns({"year": F.lit(None).cast("int"), "number": F.lit(None).cast("string")})
    return entity.similar_pairs(storage.kept(sets, "sets"), 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


# Greedy leaders by a fold over the distinct sets in order of their first row; the fixture's first lines have no year.
_LEADERS = _SETS.join(("WITH ", "")) + """, f AS (SELECT list_reduce(list({'id': id, 'toks': toks, 'leader': id} ORDER BY id), lambda done, x: list_append(done,
  {'id': x.id, 'toks': x.toks, 'leader': coalesce(list_filter(done, lambda l: l.leader = l.id
     AND len(list_intersect(l.toks, x.toks)) >= 0.72 * (len(l.toks) + len(x.toks) - len(list_intersect(l.toks, x.toks))))[1].leader, x.id)}), list_slice([{'id': 0::BIGINT, 'toks': ['x'], 'leader': 0::BIGINT}], 1, 0)) AS done FROM s),
g AS (SELECT unnest(done, recursive := true) FROM f), w AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(""" + _words(_FIRST) + """, ' '),
  lambda w: NOT list_contains([""" + ", ".join(repr(w) for w in dict.fromkeys(cues.EMPTY_WORDS)) + """], w) AND CASE WHEN regexp_matches(w, '^[0-9]+$') THEN regexp_matches(w, '^20[0-9][0-9]$') ELSE length(w) > 2 END))) AS toks FROM documents),
c AS (SELECT w.doc_id AS position, coalesce(g.leader, w.doc_id) AS leader FROM w LEFT JOIN g ON w.toks = g.toks)"""


@query(_LEADERS + " SELECT position, leader FROM c")
def dedup_clusters(spark, d):
    return entity.leader_clusters(_first_lines(spark, d), "title", "position", 0.72).select("position", "leader")


@query(_LEADERS + """ SELECT arg_max(position, (CASE WHEN position % 3 = 0 THEN 1 ELSE 0 END) * 100000000000 + (position % 50) * 1000000000 - position) AS position, leader, CAST(count(*) - 1 AS INTEGER) AS n_also FROM c GROUP BY leader""")
def cluster_representative(spark, d):
    rows = _first_lines(spark, d).withColumns({"status": F.when(F.col("position") % 3 == 0, "aberto").otherwise("verificar"), "priority": (F.col("position") % 50).cast("double"), "last_seen": F.lit("2026-08-01"), "url": F.concat(F.lit("u"), "position"), "source": F.concat(F.lit("s"), F.col("position") % 16)})
    found = entity.representatives(entity.leader_clusters(rows, "title", "position", 0.72))
    return found.select("position", "leader", F.size("also_at").alias("n_also"))


@query(f"WITH {_TITLES}, y AS (SELECT CAST(right(title, 4) AS INTEGER) AS year, min(call_id) AS id FROM titles GROUP BY 1) SELECT t.call_id, (SELECT arg_min(y.id, y.id) FROM y WHERE y.year < CAST(right(t.title, 4) AS INTEGER)) AS previous FROM titles t")
def edition_match(spark, d):
    rows = _titles(spark, d).select(F.col("call_id").alias("position"), "title", F.col("call_id").cast("string").alias("url"))
    return entity.previous_editions(rows, rows).select(F.col("position").alias("call_id"), F.col("previous_url").cast("long").alias("previous"))


# History


_RUNS = f"o AS ({X.OBSERVED_SQL}), a AS (SELECT key, status FROM o WHERE run_no = 1), b AS (SELECT key, status FROM o WHERE run_no = 2)"
_NEXT = f"WITH {_RUNS}, h AS (SELECT coalesce(a.key, b.key) AS key, a.status AS old, b.status AS new FROM a FULL JOIN b ON a.key = b.key)"


def _two_runs(spark, d):
    seen = X.observations(spark, d).select("key", F.concat(F.lit("Chamada "), "key").alias("title"), "status", (F.col("key") % 4).cast("string").alias("source"), "run_no")
    first = history.upsert(spark.createDataFrame([], history.SCHEMA), seen.filter("run_no = 1").drop("run_no"), 1)
    second = seen.filter("run_no = 2").drop("run_no")
    return second, history.upsert(storage.kept(first, "history"), second, 2)


@query(_NEXT + """ SELECT key, CASE WHEN new IS NOT NULL THEN new WHEN old = 'aberto' THEN 'verificar' ELSE old END AS status, CASE WHEN old IS NULL THEN 2 ELSE 1 END::BIGINT AS first_run, CASE WHEN new IS NULL THEN 1 ELSE 2 END::BIGINT AS last_run,
  CASE WHEN old IS NOT NULL AND new IS NOT NULL AND old <> new THEN 'status: ' || old || ' to ' || new WHEN new IS NULL AND old = 'aberto' THEN 'aberto -> verificar (not found)' ELSE '' END AS changes FROM h""")
def history_upsert(spark, d):
    return _two_runs(spark, d)[1].select("key", "status", "first_run", "last_run", F.array_join("changes", "; ").alias("changes"))


@query(_NEXT + " SELECT CASE WHEN (old IS NOT NULL AND new IS NOT NULL AND old <> new) OR (new IS NULL AND old = 'aberto') THEN 'atualizado' WHEN old IS NULL THEN 'novo' ELSE 'inicial' END AS novelty, count(*) AS n FROM h GROUP BY 1")
def novelty(spark, d):
    return _two_runs(spark, d)[1].groupBy(history.novelty(2).alias("novelty")).agg(F.count("*").alias("n"))


@query(_NEXT + " SELECT CAST(key % 4 AS VARCHAR) AS source, count(*) AS n_rows, sum(CASE WHEN old IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_new, sum(CASE WHEN old <> new THEN 1 ELSE 0 END)::BIGINT AS n_updated FROM h WHERE new IS NOT NULL GROUP BY 1")
def run_stats(spark, d):
    batch, state = _two_runs(spark, d)
    return history.run_stats(batch, state, 2)


_LISTED = "l AS (SELECT l_orderkey AS key, l_linenumber * 1000000 + l_partkey AS position, CASE l_partkey % 3 WHEN 0 THEN 'aberto' WHEN 1 THEN 'encerrado' ELSE 'futuro' END AS status, 's' || l_partkey % 4 AS source FROM lineitem)"


@query(f"WITH {_LISTED} SELECT key, arg_max(status, position) AS status, arg_min(source, position) AS source, min(position)::BIGINT AS entry, 'T' || key || ' ' || max(position) AS title FROM l GROUP BY key")
def history_repeats(spark, d):
    """Keys that one run meets several times: the last values count, under the first source."""
    status = F.element_at(F.array(*map(F.lit, ("aberto", "encerrado", "futuro"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    # A part's number may pass a million, so that two lines have one position: the line that is read first counts.
    lines = X.numbered(spark, d, "lineitem")
    rows = lines.select("__line", F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), status.alias("status"), F.concat(F.lit("s"), F.col("l_partkey") % 4).alias("source"))
    rows = rows.withColumn("title", F.concat(F.lit("T"), "key", F.lit(" "), "position"))
    return history.upsert(spark.createDataFrame([], history.SCHEMA), rows, 1).select("key", "status", "source", "entry", "title")


_EDITIONS = f"""WITH {_TITLES}, e AS (SELECT call_id AS key, CAST(right(title, 4) AS INTEGER) AS year, CASE WHEN call_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM titles),
p AS (SELECT year, run, min(key) AS first FROM e GROUP BY ALL), h AS (SELECT e.*, coalesce((SELECT min(first) FROM p WHERE p.run = 1 AND p.year < e.year AND (e.run = 2 OR first < e.key)),
  CASE WHEN run = 2 THEN (SELECT min(first) FROM p WHERE p.run = 2 AND p.year < e.year AND first < e.key) END) AS previous FROM e)"""


def _editions(spark, d):
    rows = _titles(spark, d).select(F.col("call_id").alias("key"), "title", F.lit("aberto").alias("status"), F.lit("s").alias("source"), F.col("call_id").alias("position"))
    first = history.upsert(spark.createDataFrame([], history.SCHEMA), rows.filter("key % 3 = 0"), 1)
    return history.upsert(storage.kept(first, "history"), rows.filter("key % 3 <> 0"), 2, spark.createDataFrame([], "source string"))


@query(_EDITIONS + " SELECT h.key, CAST(previous AS VARCHAR) AS new_edition_of, CAST(o.year AS INTEGER) AS previous_year FROM h LEFT JOIN e AS o ON o.key = h.previous")
def history_editions(spark, d):
    """Inserted calls linked with the earlier edition that the history or the same run has."""
    return _editions(spark, d).select("key", "new_edition_of", "previous_year")


@query(_EDITIONS + " SELECT CASE WHEN previous IS NOT NULL THEN 'nova_edicao' WHEN run = 2 THEN 'novo' ELSE 'inicial' END AS novelty, count(*) AS n FROM h GROUP BY 1")
def novelty_of_editions(spark, d):
    return _editions(spark, d).groupBy(history.novelty(2).alias("novelty")).agg(F.count("*").alias("n"))


@query(f"""WITH o AS ({X.OBSERVED_SQL}), a AS (SELECT key, status FROM o WHERE run_no = 1), b AS (SELECT key, status FROM o WHERE run_no = 2),
h AS (SELECT coalesce(a.key, b.key) AS key, a.status AS old, b.status AS new, coalesce(a.key, b.key) % 4 AS own, (coalesce(a.key, b.key) + 1) % 4 AS lister FROM a FULL JOIN b ON a.key = b.key),
g AS (SELECT *, old = 'aberto' AND own < 3 AND (new IS NULL OR lister > own) AS lost FROM h)
SELECT key, coalesce(new, CASE WHEN lost THEN 'verificar' ELSE old END) AS status,
  CASE WHEN old IS NULL THEN '' WHEN new IS NULL THEN CASE WHEN lost THEN 'aberto -> verificar (not found)' ELSE '' END
       WHEN new <> CASE WHEN lost THEN 'verificar' ELSE old END THEN 'status: ' || CASE WHEN lost THEN 'verificar' ELSE old END || ' to ' || new WHEN lost THEN 'aberto -> verificar (not found)' ELSE '' END AS changes,
  'n' || CASE WHEN old IS NULL THEN 2 ELSE 1 END AS region, 'p' || CASE WHEN new IS NULL THEN 1 ELSE 2 END AS points, CASE WHEN old IS NOT NULL AND (new IS NULL OR key % 2 = 0) THEN 1 ELSE 2 END AS attachment FROM g""")
def source_turns(spark, d):
    """A run whose sources have an order: what only a later source lists is demoted at its own source's turn; first-seen fields and attachments stay."""
    seen = X.observations(spark, d).filter("run_no <= 2").select("key", F.concat(F.lit("Chamada "), "key").alias("title"), "status", "run_no", F.lit(0).alias("position"), F.concat(F.lit("n"), "run_no").alias("region"), F.concat(F.lit("p"), "run_no").alias("points"))
    files = F.when((F.col("run_no") == 2) & (F.col("key") % 2 == 0) & F.lit(True), F.array().cast("array<int>")).otherwise(F.array(F.col("run_no")))
    files = F.when(F.col("run_no") == 1, F.array(F.lit(1))).otherwise(files)
    first = history.upsert(spark.createDataFrame([], history.SCHEMA), seen.withColumns({"source": (F.col("key") % 4).cast("string"), "attachments": files}).filter("run_no = 1").drop("run_no"), 1)
    first = storage.kept(first, "history")
    turns = spark.createDataFrame([("0", 0), ("1", 1), ("2", 2)], "source string, turn int")
    lister = (F.col("key") + 1) % 4
    known = first.select("key", F.lit(True).alias("known"))
    second = seen.filter("run_no = 2").join(known, "key", "left").withColumns({"source": lister.cast("string"), "turn": lister, "attachments": F.when(F.col("known").isNull(), F.array(F.lit(2))).otherwise(files)}).drop("run_no", "known")
    done = history.upsert(first, second, 2, turns)
    return done.select("key", "status", F.array_join("changes", "; ").alias("changes"), "region", "points", F.get("attachments", F.lit(0)).alias("attachment"))


_WEEKS = f"""WITH RECURSIVE e AS (SELECT user_id AS key, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 + 1 AS run, ts, event_id,
    CASE event_type WHEN 'view' THEN 'aberto' WHEN 'click' THEN 'aberto' WHEN 'error' THEN 'encerrado' WHEN 'signup' THEN 'verificar' ELSE 'futuro' END AS status FROM events WHERE user_id % 3 <> date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 % 3),
s AS (SELECT key, run, status FROM e QUALIFY row_number() OVER (PARTITION BY key, run ORDER BY ts DESC, event_id DESC) = 1),
f AS (SELECT key, 0 AS run, NULL::VARCHAR AS status, []::VARCHAR[] AS changes, NULL::BIGINT AS first_run, NULL::BIGINT AS last_run, NULL::BIGINT AS changed_run FROM s GROUP BY key
  UNION ALL SELECT f.key, f.run + 1, CASE WHEN n.status IS NOT NULL THEN n.status WHEN f.status = 'aberto' THEN 'verificar' ELSE f.status END,
    CASE WHEN n.status <> f.status THEN ['status: ' || f.status || ' to ' || n.status] WHEN n.status IS NULL AND f.status = 'aberto' THEN CASE WHEN list_contains(f.changes, '{history.LOST}') THEN f.changes ELSE list_append(f.changes, '{history.LOST}') END ELSE f.changes END,
    coalesce(first_run, CASE WHEN n.status IS NOT NULL THEN f.run + 1 END), CASE WHEN n.status IS NOT NULL THEN f.run + 1 ELSE last_run END,
    CASE WHEN n.status <> f.status OR (n.status IS NULL AND f.status = 'aberto') THEN f.run + 1 ELSE changed_run END
  FROM f LEFT JOIN s n ON n.key = f.key AND n.run = f.run + 1 WHERE f.run < 5)"""


@query(_WEEKS + " SELECT key, status, array_to_string(changes, '; ') AS changes, first_run, last_run, changed_run FROM f WHERE run = 5 AND first_run IS NOT NULL")
def history_weeks(spark, d):
    """All days of the events as weekly runs over a bucketed ledger; a third of the keys stays out of each week."""
    week = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7
    kind = F.create_map(*map(F.lit, ("view", "aberto", "click", "aberto", "error", "encerrado", "signup", "verificar")))
    rows = table(spark, d, "events").withColumns({"run": F.floor(week) + 1, "status": F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("futuro"))})
    last = rows.filter("user_id % 3 <> (run - 1) % 3").groupBy(F.col("user_id").alias("key"), "run").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    seen = storage.kept(last.select("key", F.concat(F.lit("Chamada "), "key").alias("title"), "status", (F.col("key") % 4).cast("string").alias("source"), "run"), "weeks")
    root = storage.scratch(spark, "ledger")
    for run in range(1, 6):
        ledger.record(spark, root, seen.filter(F.col("run") == run).drop("run"), run, buckets=8)
    return ledger.read(spark, root).select("key", "status", F.array_join("changes", "; ").alias("changes"), "first_run", "last_run", "changed_run")


# Pages


_ANCHOR = """l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1)) AS href FROM pages)"""


@query(f"WITH {_ANCHOR} SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS target, count(*) AS n FROM l WHERE starts_with(href, '/') GROUP BY ALL")
def page_links(spark, d):
    return extraction.page_links(table(spark, d, "pages")).filter(F.col("href").startswith("/")).groupBy("page_id", "href", "target").agg(F.count("*").alias("n"))


@query(f"WITH {_ANCHOR}, t AS (SELECT page_id, starts_with(href, '/') AS own, regexp_matches(lower(href), '^(#|mailto:|tel:|javascript:)') AS idle FROM l) SELECT page_id, count(*) FILTER (own) AS n_site, count(*) FILTER (idle) AS n_share FROM t GROUP BY 1")
def same_site_links(spark, d):
    rows = extraction.page_links(table(spark, d, "pages"))
    return rows.groupBy("page_id").agg(F.count_if(extraction.same_site(F.col("url"), F.col("target"))).alias("n_site"), F.count_if(extraction.is_share_link(F.col("href"), F.col("target"), F.lit(""))).alias("n_share"))


_BARE = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '  ', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({_BARE}) AS text_md5 FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(html.html_text("html")).alias("text_md5"))


@query("SELECT page_id, md5(html) AS text_md5 FROM pages")
def pdf_text(spark, d):
    """Bytes through a reader that the caller brings; here one that takes them as UTF-8."""
    return table(spark, d, "pages").select("page_id", F.md5(html.pdf_text(lambda raw: raw.decode())(F.col("html").cast("binary"))).alias("text_md5"))


_SCRIPTED = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<html><body><div id="app"> </div><script src="/a.js"></script></body></html>' WHEN 1 THEN concat('<html><a href="/x">x</a><script>', repeat('var a=1;', CAST(300 + page_id % 7 AS INT)), '</script></html>')
  WHEN 2 THEN concat('<p>', repeat('word ', 1000), '</p><script>', repeat('var a=1;', 300), '</script>') ELSE html END AS html FROM {pages}"""


@query(f"""WITH p AS ({_SCRIPTED.format(pages='pages')}), s AS (SELECT page_id, (coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0) + CASE WHEN page_id % 5 = 0 THEN 200 ELSE 0 END)::INTEGER AS script_chars, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href'))::INTEGER AS n_links FROM p)
SELECT page_id, script_chars, n_links, page_id % 5 < 2 AS needs_script FROM s""")
def js_page_heuristic(spark, d):
    """Pages of which two fifths are shells for scripts: an empty mount point, or much script around one link."""
    pages = spark.sql(_SCRIPTED, pages=table(spark, d, "pages"))
    return extraction.script_shell(pages).select("page_id", "script_chars", "n_links", "needs_script")


@query("""WITH i AS (SELECT l_orderkey AS h, l_linenumber AS pos, l_partkey % 6 AS k FROM lineitem), j AS (SELECT *, CASE k WHEN 0 THEN 13 WHEN 1 THEN -7 WHEN 2 THEN -10 WHEN 3 THEN -10 WHEN 4 THEN 3 ELSE 11 END AS s,
  CASE k WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 11 WHEN 3 THEN 10 WHEN 4 THEN 11 ELSE 6 END AS n FROM i),
b AS (SELECT h, min(pos) AS first, count(*) AS n_links, arg_max(pos, s * 100000 - n * 1000 - pos) AS best FROM j GROUP BY h)
SELECT 'https://x.org/' || h || '/' || best AS url, CAST(first AS INTEGER) AS position, n_links FROM b""")
def attachment_grouping(spark, d):
    k = F.col("l_partkey") % 6
    label = F.element_at(F.array(*map(F.lit, ("Edital", "Anexo I", "Retificacao", "Formulario", "Clique aqui", "Baixar"))), (k + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("PDF", "PDF", "", "", "PDF", "DOC"))), (k + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("position"), F.concat(F.lit("Edital numero "), "l_orderkey").alias("header"), label.alias("label"), F.concat(F.lit("https://x.org/"), "l_orderkey", F.lit("/"), "l_linenumber").alias("url"), kind.alias("file"))
    return extraction.group_attachments(rows).select("url", "position", "n_links")


@query("""WITH p AS (SELECT o_custkey % 50 AS source, o_orderkey % 40 AS page_no, count(*) FILTER (o_orderpriority <> '5-LOW') AS n_new FROM orders GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_no) - 1 + min(page_no) OVER (PARTITION BY source) AS place, row_number() OVER (PARTITION BY source ORDER BY page_no) AS turn FROM p),
r AS (SELECT *, coalesce(bool_or(place <> page_no OR n_new = 0) OVER (PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM q)
SELECT source, page_no, n_new FROM r WHERE NOT ended AND place = page_no AND turn <= 12""")
def pagination_walk(spark, d):
    pages = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("source"), (F.col("o_orderkey") % 40).alias("page_no")).agg(F.count_if(F.col("o_orderpriority") != "5-LOW").alias("n_new"))
    return extraction.walk_pages(pages, 12)


#: What a page's pager holds, by page_id: no pager, a missing page, the host's first page again, else its next one; in the four forms by turns.
_TO = """nullif(CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 13 = 6 THEN site || '/missing/' || page_id WHEN page_id % 7 = 3 THEN first_value(addr) OVER h ELSE lead(addr) OVER h END, addr)"""
_LISTINGS = f"""SELECT page_id, addr, html, site, n, {_TO} AS goes_to FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS addr, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
  row_number() OVER (PARTITION BY regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) ORDER BY page_id) AS n FROM {{pages}}) AS p WINDOW h AS (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _listings(spark, d):
    """The pages with a pager each, their items, and sources: every site with three addresses, every other site as sections."""
    rows = spark.sql(_LISTINGS.replace("lead(addr) OVER h", "lead(addr) OVER (PARTITION BY site ORDER BY page_id)"), pages=table(spark, d, "pages"))
    forms = ("<link rel='next' href='{u}'>", "<p><a href='{u}'>{n}</a></p>", "<ul class='pager'><li><a href='/en'>1</a><li><a href='{u}'>Próxima página</a></ul>", "<p><a href='{u}' title='Seguinte'>&gt;&gt;&gt;</a></p>")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % len(forms) + 1).cast("int"))
    pager = F.replace(F.replace(form, F.lit("{u}"), F.col("goes_to")), F.lit("{n}"), (F.col("n") + 1).cast("string"))
    rows = storage.kept(rows.select("page_id", F.col("addr").alias("url"), F.concat("html", F.coalesce(pager, F.lit(""))).alias("html"), "site", "n"), "listings")
    own = extraction.page_links(table(spark, d, "pages")).filter(F.col("href").startswith("/"))
    items = own.select(F.regexp_replace("url", "#.*$", "").alias("page"), "position", F.col("target").alias("url"), (F.length("href") > 5).alias("relevant"))
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("url")))
    sites = rows.groupBy("site").agg(*[at(n).alias(f"u{n}") for n in (1, 3)])
    urls = F.array_compact(F.array(F.concat("site", F.lit("/moved")), F.col("u1"), F.col("u3")))
    sources = sites.select(F.col("site").alias("source"), urls.alias("urls"), (F.length("site") % 2 == 0).alias("read_all"), F.lit("auto").alias("way"), F.lit(None).cast("string").alias("parameter"), F.lit(1).alias("first"), F.lit(6).alias("most"))
    return rows, items, sources


_WALKED = f"""WITH RECURSIVE p AS ({_LISTINGS.format(pages='pages')}), {_ANCHOR}, items AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS page, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS item, length(href) > 5 AS relevant FROM l WHERE starts_with(href, '/')),
raw AS (SELECT page, count(*) AS n_raw FROM (SELECT regexp_replace(url, '#.*$', '') AS page FROM l WHERE starts_with(href, '/')) GROUP BY page),
starts AS (SELECT site AS source, 0 AS place, site || '/moved' AS start FROM p GROUP BY site UNION ALL SELECT site, 1, addr FROM p WHERE n = 1 UNION ALL SELECT site, 2, addr FROM p WHERE n = 3),
w AS (SELECT source, place, start, 0 AS turn, 1 AS page_no, start AS url, [start] AS path FROM starts
  UNION ALL SELECT source, place, start, turn + 1, page_no + 1, to_url, list_append(path, to_url) FROM (SELECT w.*, {{go}} AS to_url FROM w JOIN p ON p.addr = w.url) WHERE turn < 5 AND to_url IS NOT NULL AND NOT list_contains(path, to_url)),
met AS (SELECT w.*, p.addr IS NOT NULL AS ok, coalesce(n_raw, 0) AS n_raw, {{go}} AS to_url FROM w LEFT JOIN p ON p.addr = w.url LEFT JOIN raw ON raw.page = w.url),
seen AS (SELECT source, place, item, min(turn) AS turn FROM met JOIN items ON items.page = met.url WHERE relevant GROUP BY ALL),
c AS (SELECT source, place, turn, count(*) AS n_new FROM seen GROUP BY ALL),
e AS (SELECT met.*, coalesce(n_new, 0) AS n_new, CASE WHEN NOT ok THEN 'failed' WHEN turn > 0 AND coalesce(n_new, 0) = 0 THEN 'nothing new' WHEN n_raw = 0 THEN 'empty' WHEN to_url IS NULL THEN 'no next' WHEN turn = 5 THEN 'cap' WHEN list_contains(path, to_url) THEN 'repeat' END AS stop FROM met LEFT JOIN c USING (source, place, turn)),
ends AS (SELECT source, place, min(turn) AS last_turn FROM e WHERE stop IS NOT NULL GROUP BY ALL), g AS (SELECT e.* FROM e JOIN ends USING (source, place) WHERE turn <= last_turn)""".replace("{go}", "CASE WHEN page_id % 4 = 1 AND page_no <> n THEN NULL ELSE goes_to END")


@query(_WALKED + " SELECT source, CAST(place AS INTEGER) AS place, turn, page_no, url, n_raw, n_new, stop FROM g")
def page_walk(spark, d):
    """Walks from three addresses of every site over its pages, planted loops, gaps and missing pages included."""
    pages, items, sources = _listings(spark, d)
    starts = extraction.candidate_order(sources, spark.createDataFrame([], "source string, url string")).withColumnRenamed("url", "start")
    return walk.walks(starts, *walk.read_once(pages, items), items)[0].drop("start")


_READ = _WALKED + """, t AS (SELECT source, place, any_value(start) AS url, count(*) FILTER (coalesce(stop, '') <> 'failed') AS n_pages, sum(n_new)::BIGINT AS n_items, max(stop) AS stop, bool_or(turn = 0 AND coalesce(stop, '') <> 'failed') AS answered, length(source) % 2 = 0 AS read_all FROM g GROUP BY source, place),
u AS (SELECT source, arg_min(place, CASE WHEN read_all OR n_items > 0 THEN place ELSE place + 100 END) AS place, any_value(read_all) AS read_all FROM t WHERE answered GROUP BY source),
f AS (SELECT seen.source, item, min(seen.place) AS place FROM seen JOIN ends ON ends.source = seen.source AND ends.place = seen.place AND seen.turn <= ends.last_turn JOIN u ON u.source = seen.source AND (u.read_all OR u.place = seen.place) GROUP BY ALL)"""


@query(_READ + " SELECT source, CAST(place AS INTEGER) AS place, item AS url FROM f")
def source_items(spark, d):
    """One run: alternatives read by the first address that gives anything, sections joined."""
    pages, items, sources = _listings(spark, d)
    return walk.read_sources(sources, spark.createDataFrame([], "source string, url string"), pages, items)[0].select("source", "place", "url")


@query(_READ + " SELECT t.source, CAST(t.place AS INTEGER) AS place, t.url, answered, n_pages, n_items, stop, coalesce(u.place = t.place, false) AS used FROM t LEFT JOIN u ON u.source = t.source")
def source_attempts(spark, d):
    """The log of that run, and which address of each source it remembers."""
    pages, items, sources = _listings(spark, d)
    _, used, attempts = walk.read_sources(sources, spark.createDataFrame([], "source string, url string"), pages, items)
    return attempts.join(used.withColumnRenamed("url", "good"), "source", "left").select("source", "place", "url", "answered", "n_pages", "n_items", "stop", F.coalesce(F.col("good") == F.col("url"), F.lit(False)).alias("used"))


_HINT = " + ".join(f"CASE WHEN contains(p, '{h}') THEN {w} WHEN contains(t, '{h}') THEN {int(w * 0.7)} ELSE 0 END" for h, w in cues.LISTING_HINTS)


@query(f"""WITH {_TITLES}, x AS (SELECT call_id, {_words('title')} AS t, 'editais chamada ' || call_id || '_' || right(title, 4) || ' pdf' AS p, url FROM titles)
SELECT call_id, CAST(greatest(0, {_HINT} + 4 - 8 - CASE WHEN call_id >= 10 THEN 3 ELSE 0 END) AS INTEGER) AS score FROM x""")
def link_score(spark, d):
    return _titles(spark, d).select("call_id", scoring.listing_score(F.col("title"), F.col("url")).cast("int").alias("score"))


@query(f"""WITH {_ANCHOR}, n AS (SELECT page_id, href, {_words("replace(href, '/', ' ')")} AS t FROM l)
SELECT page_id, count(*) FILTER (length(t) < 12 OR regexp_matches(t, '^[0-9 ]+$')) AS n_noise FROM n GROUP BY 1""")
def noise_filter(spark, d):
    rows = extraction.page_links(table(spark, d, "pages"))
    return rows.groupBy("page_id").agg(F.count_if(T.noise(F.translate("href", "/", " "), L.NOISE)).alias("n_noise"))


@query("SELECT p_name, length(lower(p_name)) < 12 AS generic, count(*) AS n FROM part GROUP BY ALL")
def generic_label(spark, d):
    return table(spark, d, "part").groupBy("p_name", T.generic_label(F.col("p_name")).alias("generic")).agg(F.count("*").alias("n"))


@query("SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages) GROUP BY host")
def url_dedup_first(spark, d):
    return entity.first_by(table(spark, d, "pages").select(T.host_of(F.col("url")).alias("host"), "page_id"), "host", "page_id")


_MENU = "|".join(f"(?:{p})" for p in cues.NAVIGATION)


@query(rf"""WITH titles AS ({X.TITLES_SQL}), n AS (SELECT id, title, lower(trim(regexp_replace(replace(replace(strip_accents(title), 'º', 'o'), 'ª', 'a'), '\s+', ' ', 'g'))) AS t FROM titles)
SELECT id, t = '' OR regexp_matches(t, '{_MENU}') OR (NOT regexp_matches(title, '(?i){cues.OPPORTUNITY_MARKS}') AND length(t) > 55 AND NOT regexp_matches(t, '\bn[ºo°]?\s*\d|\b\d{{1,3}}/\d{{4}}\b')
  AND len(regexp_extract_all(title, '[a-zà-ÿ][A-ZÀ-Þ]')) >= 1) AS menu FROM n""")
def navigation_filter(spark, d):
    return X.titles(spark, d).select("id", extraction.is_navigation(F.col("title")).alias("menu"))


_HREFS = (
    ("../x.pdf", "https://h.org/x.pdf"), ("./y", "https://h.org/d/y"), ("../../z?q=1", "https://h.org/z?q=1"), ("/a/../b", "https://h.org/b"), ("?page=2", "https://h.org/d/list?page=2"),
    ("#top", "https://h.org/d/list?x=1#top"), ("", "https://h.org/d/list?x=1"), ("..", "https://h.org/"), (".", "https://h.org/d/"), ("//o.org/c", "https://o.org/c"), ("x/./y/../z#t", "https://h.org/d/x/z#t"),
    ("mailto:a@b.c", "mailto:a@b.c"), ("http://o.org/a/../b", "http://o.org/a/../b"), ("x..y/.z", "https://h.org/d/x..y/.z"), ("/a/b/.", "https://h.org/a/b/"), ("../e/..", "https://h.org/"),
)


@query("SELECT p_partkey AS id, list_extract([" + ", ".join(f"'{t}'" for _, t in _HREFS) + f"], CAST(p_partkey % {len(_HREFS)} + 1 AS BIGINT)) AS target FROM part")
def relative_links(spark, d):
    """Hrefs of every form against one page."""
    href = F.element_at(F.array(*[F.lit(h) for h, _ in _HREFS]), (F.col("p_partkey") % len(_HREFS) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), extraction.resolve(F.lit("https://h.org/d/list?x=1#f"), href).alias("target"))


@query(f"WITH {CALLS} SELECT call_id, 'https://h.org/list?page=' || (call_id % 5 + 2) AS next_url FROM calls WHERE call_id % 6 < 5")
def next_page(spark, d):
    number = (F.col("call_id") % 5 + 1).cast("int")
    target = F.concat(F.lit("/list?page="), (number + 1).cast("string"))
    shapes = (
        ("<a href='/x'>9</a><link rel='next' href='", "'>"),
        ("<a href='", "'>{n}</a>"),
        ("<a href='/x'>proximo evento</a><div class='box pagination'><span><a href='/y'>1</a></span><a href='https://o.org/z'>next</a><a href='", "'><i>Próxima página de muitos outros resultados</i></a></div>"),
        ("<div class='pager'><a href='/y'>1</a></div><a href='/l'>Última próxima</a><a href='#'>»</a><a href='", "'>»</a>"),
        ("<a href='/list'>next</a><a href='", "' title='Seguinte'>ir</a>"),
        ("<a href='/x'>Edital</a><a href='", "'>uma chamada</a>"),
    )
    anchor = F.element_at(F.array(*[F.concat(F.lit(a), target, F.replace(F.lit(z), F.lit("{n}"), (number + 1).cast("string"))) for a, z in shapes]), (F.col("call_id") % 6 + 1).cast("int"))
    rows = X.calls(spark, d).select(F.col("call_id").alias("page_id"), number.alias("page_no"), F.lit("https://h.org/list").alias("url"), anchor.alias("html"))
    return extraction.next_pages(rows).select(F.col("page_id").alias("call_id"), "next_url")


@query("""WITH s AS (SELECT s_suppkey AS source, ['u' || s_suppkey || 'a', 'u' || s_suppkey || 'b'] AS urls, CASE WHEN s_suppkey % 2 = 0 THEN 'u' || s_suppkey || 'b' END AS good FROM supplier)
SELECT source, CASE WHEN good IS NOT NULL THEN good WHEN source % 3 = 0 THEN urls[2] ELSE urls[1] END AS url FROM s""")
def url_memory(spark, d):
    """Addresses tried, the remembered one first; the first that gives anything is remembered."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"))
    sources = s.select("source", F.array(F.concat(F.lit("u"), "source", F.lit("a")), F.concat(F.lit("u"), "source", F.lit("b"))).alias("urls"))
    memory = s.filter("source % 2 = 0").select("source", F.concat(F.lit("u"), "source", F.lit("b")).alias("url"))
    tried = extraction.candidate_order(sources, memory).withColumn("n_items", F.when((F.col("source") % 3 == 0) & F.col("url").endswith("a"), 0).otherwise(1))
    return extraction.remember(memory, extraction.first_productive(tried))


@query(f"""WITH {_TITLES}, x AS (SELECT call_id % 16 AS source, call_id, right(title, 4) AS y FROM titles), g AS (SELECT source, 'p' || y AS url, count(*) AS n_calls FROM x GROUP BY ALL)
SELECT source, url, n_calls, CAST(row_number() OVER (PARTITION BY source ORDER BY n_calls DESC, url) AS INTEGER) AS place FROM g QUALIFY place <= 4""")
def page_suggestions(spark, d):
    """The pages that list most classifiable calls, four a source."""
    rows = _titles(spark, d).withColumn("n", T.normalise_words(F.col("title"))).filter(~T.noise(F.col("title"), L.NOISE))
    per = rows.groupBy((F.col("call_id") % 16).alias("source"), F.concat(F.lit("p"), F.element_at(F.split("title", " "), -1)).alias("url")).agg(F.count("*").alias("n_calls")).withColumn("score", F.lit(0))
    return extraction.suggestions(per).drop("score")


_LABELS = ("Editais abertos", "Chamadas públicas", "Contato", "Bolsas e auxílios", "Notícias do portal", "Licitações e editais", "Oportunidades internacionais", "Programas", "Calls for proposals", "Sobre nós")
_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(f"""WITH a AS (SELECT page_id, {_SITE} AS source, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url, url AS raw, [{', '.join(repr(x) for x in _LABELS)}][CAST(page_id % {len(_LABELS)} + 1 AS BIGINT)] AS label FROM pages),
b AS (SELECT *, {_words('label')} AS t, {_words("replace(replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '-', ' '), '/', ' ')")} AS p FROM a),
z AS (SELECT source, url, raw, label, page_id, CASE WHEN {_has("concat_ws(' ', t, p)", cues.LISTING_VETOES)} THEN 0 ELSE greatest(0, {_HINT} - CASE WHEN regexp_matches(url, '[0-9]{{2,}}[-_/][0-9]{{4}}') THEN 3 ELSE 0 END) END AS score FROM b),
m AS (SELECT url, arg_min(page_id, raw) AS page_id FROM z GROUP BY url), s AS (SELECT source, url, max(score) AS score, min(page_id) AS first, arg_min(label, page_id - score::BIGINT * 1000000000) AS label FROM z WHERE score > 0 GROUP BY source, url),
r AS (SELECT s.*, page_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, first) AS place FROM s JOIN m USING (url) QUALIFY place <= 11), -- the twelfth is the link to a page that is gone
{_ANCHOR}, i AS (SELECT DISTINCT page_id, {_SITE} || href AS url, regexp_extract(href, '([^/]*)/*$', 1) AS slug FROM l WHERE starts_with(href, '/')),
n AS (SELECT page_id, url, concat_ws(' ', {_words("slug")}, {_words("replace(replace(url, '-', ' '), '/', ' ')")}) AS n, {_words("slug")} AS label FROM i),
c AS (SELECT page_id, count(*) FILTER (length(label) >= 12 AND len({_TAGS}) > 0) AS n_calls FROM n GROUP BY page_id),
f AS (SELECT r.*, coalesce(n_calls, 0) + r.page_id % 4 AS n_calls, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_calls, 0) + r.page_id % 4 DESC, score DESC, url) AS rank FROM r LEFT JOIN c USING (page_id))
SELECT source, url, label, CAST(score AS INTEGER) AS score, n_calls, CAST(CASE WHEN n_calls > 0 AND rank <= 4 THEN rank END AS INTEGER) AS place FROM f""")
def replacement_pages(spark, d):
    """Every site's home page (links to all its pages, labels by turns) searched for pages that list calls; a page has up to three planted ones."""
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    # Of pages of one url the one read first counts, as DuckDB's arg_min takes it on one thread.
    rows = X.numbered(spark, d, "pages").withColumnRenamed("__line", "line").withColumn("site", site)
    call = lambda k: F.when(F.col("page_id") % 4 > k, F.concat(F.lit("<a href='/c/"), "page_id", F.lit(f"/{k}'>Chamada pública de mobilidade acadêmica número "), "page_id", F.lit("</a>"))).otherwise(F.lit(""))
    own = rows.select("line", "url", F.concat("html", *map(call, range(3))).alias("html"))
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("page_id") % len(_LABELS) + 1).cast("int"))
    link = F.concat(F.lit("<a href='"), "url", F.lit("'>"), label, F.lit("</a>"))
    home = rows.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", link.alias("link")))), lambda x: x["link"]), " ").alias("links"))
    home = home.select(F.lit(None).cast(rows.schema["line"].dataType).alias("line"), F.concat("site", F.lit("/")).alias("url"), F.concat(F.lit("<a href='https://o.org/editais'>Editais</a><a href='#x'>Editais</a>"), "links", F.lit("<a href='/gone/editais'>Edital antigo</a>")).alias("html"))
    pages = storage.kept(own.unionByName(home), "pages")
    return discovery.replacements(rows.select(F.col("site").alias("source"), F.concat("site", F.lit("/")).alias("url")).distinct(), pages).withColumn("score", F.col("score").cast("int"))


# Configuration and panel


#: A source a supplier, with the address of the page of its number; the faults go by its number.
_SOURCES = """SELECT CASE WHEN s_suppkey % 9 = 0 THEN concat('Shared ', s_suppkey % 27) WHEN s_suppkey % 17 = 0 THEN '' ELSE s_name END AS name,
  CASE s_suppkey % 6 WHEN 0 THEN 'es' WHEN 1 THEN 'nacional' WHEN 2 THEN 'mars' WHEN 3 THEN '' ELSE 'internacional' END AS region,
  CASE s_suppkey % 8 WHEN 0 THEN {none} WHEN 1 THEN {l}url{r} WHEN 2 THEN {l}'a.org/x', bare{r} WHEN 3 THEN {l}concat(bare, '?pg=1&pg=2'){r} WHEN 4 THEN {l}concat(bare, '?status=closed'){r} WHEN 5 THEN {l}concat(bare, '/a=b'){r}
    WHEN 6 THEN {l}concat(bare, '/{{pagina}}'), ''{r} ELSE {l}bare{r} END AS urls,
  CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://other.org' WHEN 2 THEN host ELSE concat('https://', host) END AS root,
  CASE WHEN s_suppkey % 4 > 0 THEN 'ul li' END AS selector, CASE s_suppkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'query' WHEN 2 THEN 'template' WHEN 3 THEN 'scroll' END AS page_kind,
  CASE WHEN s_suppkey % 3 = 0 THEN 'pg' END AS page_parameter, CAST(s_suppkey % 40 AS INT) AS max_pages, s_suppkey
FROM {supplier} AS s JOIN (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM {pages}) AS p ON page_id = s_suppkey"""


def _configured(spark, d):
    sql = _SOURCES.format(none="array()", l="array(", r=")", supplier="{supplier}", pages="{pages}")
    # The marker's braces would be read as a table's name.
    sql = sql.replace("/{pagina}", "/<pagina>")
    rows = spark.sql(sql, supplier=table(spark, d, "supplier"), pages=table(spark, d, "pages"))
    return rows.withColumn("urls", F.transform("urls", lambda u: F.replace(u, F.lit("<pagina>"), F.lit("{pagina}"))))


_CONFIGURED = "src AS (" + _SOURCES.format(none="[]::VARCHAR[]", l="[", r="]", supplier="supplier", pages="pages") + ")"
_HOST_OF = lambda u: f"regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
_ANY = lambda test: f"len(list_filter(urls, lambda u: {test})) > 0"
_RULES = (
    ("error", "name missing", "name = ''"), ("error", "region missing", "region = ''"), ("error", "urls missing", "len(urls) = 0"), ("error", "name repeated", "count(*) OVER (PARTITION BY name) > 1"),
    ("error", "region invalid", "region NOT IN ('', 'es', 'nacional', 'internacional')"), ("error", "url empty", _ANY("u = ''")), ("error", "url without scheme", _ANY("u <> '' AND NOT regexp_matches(u, '^https?://')")),
    ("warning", "filter in path", _ANY("NOT contains(u, '?') AND contains(u, '=')")), ("warning", "parameter repeated", _ANY("contains(u, 'pg=1&pg=2')")), ("warning", "closed calls only", _ANY("contains(u, '?status=closed')")),
    ("warning", "root missing", "root = ''"), ("error", "root without scheme", "root <> '' AND NOT starts_with(root, 'https://')"),
    ("error", "root of another site", f"root <> '' AND len(urls) > 0 AND NOT list_contains(list_transform(urls, lambda u: {_HOST_OF('u')}), {_HOST_OF("CASE WHEN contains(root, '://') THEN root ELSE 'https://' || root END")})"),
    ("warning", "selector missing", "selector IS NULL"), ("error", "page kind invalid", "page_kind = 'scroll'"), ("error", "template without marker", f"page_kind = 'template' AND NOT {_ANY("contains(u, 'pagina}')")}"),
    ("error", "query without parameter", "page_kind = 'query' AND page_parameter IS NULL"), ("warning", "many pages", "max_pages > 25"),
)


@query(f"WITH {_CONFIGURED}, found AS (" + " UNION ALL ".join(f"SELECT name, '{level}' AS level, '{rule}' AS rule FROM (SELECT name, {test} AS hit FROM src) WHERE hit" for level, rule, test in _RULES) + ") SELECT name, level, rule, count(*) AS n FROM found GROUP BY ALL")
def config_lint(spark, d):
    return lint.findings(_configured(spark, d)).groupBy("name", "level", "rule").agg(F.count("*").alias("n"))


@query(f"""WITH {_CONFIGURED}, u AS (SELECT *, list_transform(urls, lambda u: CASE WHEN u <> '' AND NOT regexp_matches(u, '^https?://') THEN 'https://' || u ELSE u END) AS whole, CASE WHEN root = '' OR starts_with(root, 'https://') THEN root ELSE 'https://' || root END AS full_root FROM src),
h AS (SELECT *, list_filter(list_transform(whole, lambda u: {_HOST_OF('u')}), lambda h: h <> '') AS hosts FROM u),
f AS (SELECT *, CASE WHEN len(hosts) > 0 AND root <> '' AND NOT list_contains(hosts, {_HOST_OF('full_root')}) THEN 'https://' || hosts[1] ELSE full_root END AS new_root FROM h)
SELECT s_suppkey AS id, array_to_string(whole, ' ') AS urls, new_root AS root, concat_ws(',', CASE WHEN whole <> urls THEN 'scheme of a url' END, CASE WHEN new_root <> root THEN 'root' END) AS fixes FROM f""")
def config_fixed(spark, d):
    """Those sources with their safe corrections, and what was corrected."""
    return lint.fixed(_configured(spark, d)).select(F.col("s_suppkey").alias("id"), F.array_join("urls", " ").alias("urls"), "root", F.array_join("fixes", ",").alias("fixes"))


@query("""WITH s AS (SELECT s_suppkey AS source, s_suppkey % 4 AS k, CAST(s_suppkey % 9 AS VARCHAR) AS pages, s_name FROM supplier)
SELECT source, 'pages' AS key, CASE WHEN k = 1 THEN pages ELSE '3' END AS value FROM s UNION ALL SELECT source, 'quiet', 'true' FROM s UNION ALL SELECT source, 'title', s_name FROM s WHERE k = 1""")
def config_overlay(spark, d):
    """Every source's settings: its own over the defaults; notes are left out."""
    k = F.col("s_suppkey")
    own = F.create_map(F.lit("pages"), (k % 9).cast("string"), F.lit("title"), F.col("s_name"), F.lit("_note"), F.lit("y"))
    overrides = F.when(k % 4 == 1, own).when(k % 4 == 2, F.create_map(F.lit("_pages"), F.lit("7")))
    return storage.effective_config(table(spark, d, "supplier").select(k.alias("source"), overrides.alias("overrides")), {"pages": "3", "quiet": "true"})


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def versioned_state(spark, d):
    """A state written twice: readers see the last whole version, and a name that was never written is an empty table."""
    root = storage.scratch(spark, "state")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    storage.swap_in(rows, root, "1")
    storage.swap_in(rows.filter("id % 2 = 0"), root, "2")
    return storage.read_current(spark, root).unionByName(storage.read_json_or(spark, f"{root}/never", "id long, name string"))


_PANEL = _EVAL + ", " + _RESTR + ", q AS (SELECT call_id, status, n, (score * CASE status WHEN 'encerrado' THEN 0.15 ELSE 1.0 END)::DOUBLE AS priority, CASE source_no % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'nacional' ELSE 'internacional' END AS region, CASE WHEN blk THEN 'restricao_conhecida' WHEN fav THEN 'via_individual' WHEN att THEN 'verificar' ELSE 'sem_catalogo' END AS eligibility FROM r)"


def _panel(spark, d):
    rows = scoring.evaluate(X.calls(spark, d).drop("deadline"), "text", AS_OF).withColumn("r", scoring.restrictions(F.col("text"), F.lit("")))
    region = F.element_at(F.array(F.lit("es"), F.lit("nacional"), F.lit("internacional")), (F.col("source_no") % 3 + 1).cast("int"))
    return rows.withColumns({"priority": F.col("score") * F.when(F.col("status") == "encerrado", 0.15).otherwise(1.0), "region": region, "eligibility": scoring.eligibility(F.col("r")), "novelty": F.lit("novo"), "first_seen": F.col("call_id")})


@query(_PANEL + " SELECT 'recommended' AS view, count(*) AS n FROM q WHERE status = 'aberto' AND priority >= 30 UNION ALL SELECT 'open', count(*) FROM q WHERE status = 'aberto' UNION ALL SELECT 'check', count(*) FROM q WHERE status = 'verificar' UNION ALL SELECT 'new', count(*) FROM q UNION ALL SELECT 'history', count(*) FROM q")
def panel_views(spark, d):
    """All views' sizes in one pass."""
    rows = _panel(spark, d)
    tests = {"recommended": panel.recommended(), "open": F.col("status") == "aberto", "check": F.col("status") == "verificar", "new": F.col("novelty").isin(*panel.NOVEL), "history": F.lit(True)}
    counted = rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("view"), F.col(k).alias("n")) for k in tests])))


@query(_PANEL + " SELECT call_id FROM q WHERE region = 'nacional' AND eligibility <> 'restricao_conhecida' AND contains(n, 'mobilidade')")
def facet_search(spark, d):
    return panel.facets(_panel(spark, d), region="nacional", eligibility="unblocked", themes=("mobilidade", "cooperacao", "internacional"), search="MOBILIDADE", searched=("text", "region")).select("call_id")


#: A search for each kind of field, one over the border of two, one of two characters.
_SEARCHES = ("CHAMADA 12", "fonte 7 nacional", "funding or fellowship | deadline 1", "Partner Abroad", "edital 7", "7 ")
_TITLE = "CASE WHEN call_id % 7 = 0 THEN concat('Édital ', call_id) ELSE concat('Chamada ', call_id) END"
_REASON = f"array_to_string(list_filter([CASE WHEN axes > 0 THEN array_to_string({_LABELLED}[1:2], ' / ') END, CASE WHEN intl THEN 'international' END, CASE WHEN {_has('n', L.PROFILE.funding)} THEN 'funding or fellowship' END, 'deadline ' || strftime(dl, '%d/%m/%Y')], lambda x: x IS NOT NULL), ' | ')"


@query(_EVAL + f""", x AS (SELECT call_id, strip_accents(lower(concat_ws(' ', {_TITLE}, 'Fonte ' || source_no, CASE source_no % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'nacional' ELSE 'internacional' END, {_REASON},
  CASE WHEN contains(n, 'joint research') THEN 'Joint research partner abroad' END))) AS text FROM g WHERE call_id % 11 > 0)
SELECT asked, call_id FROM x, (VALUES {', '.join(f"('{a}')" for a in _SEARCHES)}) AS s(asked) WHERE contains(text, trim(lower(asked)))""")
def panel_search(spark, d):
    """The panel's eight fields through an index of two runs: all calls, then those with other titles and those taken out."""
    root, region = storage.scratch(spark, "search"), F.col("region")
    fields = search.searched_text(F.col("title"), F.concat(F.lit("Fonte "), "source_no"), region, F.col("relevance_reason"), F.col("axis_labels"), F.col("themes"), F.col("r"), F.col("audience"))
    rows = _panel(spark, d).withColumn("title", F.expr(_TITLE))
    rows = storage.kept(rows.select("call_id", fields.alias("text")), "panel")
    first = rows.withColumn("text", F.when(F.col("call_id") % 7 == 0, F.replace("text", F.lit("Édital"), F.lit("Chamada"))).otherwise(F.col("text")))
    search.extend(first, root, "call_id", "text")
    gone = F.col("call_id") % 11 == 0
    search.extend(rows.filter(gone | (F.col("call_id") % 7 == 0)).withColumn("text", F.when(~gone, F.col("text"))), root, "call_id", "text")
    found = [search.search(spark, root, asked).select(F.lit(asked).alias("asked"), F.col("key").alias("call_id")) for asked in _SEARCHES]
    return reduce(DataFrame.unionByName, found)


@query(_PANEL.replace("q AS (SELECT call_id,", f"q AS (SELECT call_id, date_diff('day', {DAY}, dl) AS days,") + " SELECT call_id, CAST(row_number() OVER (ORDER BY status = 'aberto' DESC, priority DESC, coalesce(days, 99999), call_id) AS INTEGER) AS place FROM q QUALIFY place <= 100")
def panel_top(spark, d):
    """The panel's first hundred rows, a report of fixed length."""
    keys = [*panel.order("default"), F.col("call_id")]
    top = _panel(spark, d).select("call_id", "status", "priority", "days_left").orderBy(*keys).limit(100)
    return top.select("call_id", F.row_number().over(Window.orderBy(*keys)).alias("place"))


def _panel_sort(name: str):
    """A report of fixed length: the first hundred rows in one of the panel's orders."""

    def run(spark, d):
        keys = [*panel.order(name), F.col("call_id")]
        rows = _panel(spark, d).withColumns({"novelty": F.when(F.col("call_id") % 3 == 0, "atualizado").otherwise("novo"), "first_seen": F.col("call_id") % 10})
        top = rows.select("call_id", "status", "priority", "days_left", "novelty", "first_seen").orderBy(*keys).limit(100)
        return top.select("call_id", F.row_number().over(Window.orderBy(*keys)).alias("place"))

    return run


_SORTS = {"deadline": "CASE WHEN status = 'aberto' THEN coalesce(days, 999999) ELSE 999999 END, priority DESC", "recent": "call_id % 10 DESC, call_id % 3 = 0 DESC", "relevance": "priority DESC, call_id % 3 = 0 DESC, coalesce(days, 999999)"}
for _name, _keys in _SORTS.items():
    QUERIES[f"panel_sort_{_name}"] = _panel_sort(_name)
    ORACLE_SQL[f"panel_sort_{_name}"] = _PANEL.replace("q AS (SELECT call_id,", f"q AS (SELECT call_id, date_diff('day', {DAY}, dl) AS days,") + f" SELECT call_id, CAST(row_number() OVER (ORDER BY {_keys}, call_id) AS INTEGER) AS place FROM q QUALIFY place <= 100"


@query(_PANEL + " SELECT CASE region WHEN 'es' THEN 'Espírito Santo' WHEN 'nacional' THEN 'Brasil' ELSE 'Exterior' END AS region, CASE eligibility WHEN 'via_individual' THEN 'Candidatura individual' WHEN 'restricao_conhecida' THEN 'Restrição conhecida' WHEN 'verificar' THEN 'Verificar exigências' ELSE 'Elegibilidade não catalogada' END AS eligibility, count(*) AS n FROM q GROUP BY ALL")
def panel_labels(spark, d):
    return _panel(spark, d).groupBy(*[panel.label(k, F.col(k)).alias(k) for k in ("region", "eligibility")]).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS url, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def saved_view(spark, d):
    """The rows a reader has marked; the marks are a table."""
    marks = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("url"))
    return panel.view(table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status")), "saved", marks)


@query("SELECT '{\"id\":' || p_partkey || ',\"name\":\"<b>' || p_name || '<\\/b>\"}' AS value FROM part")
def panel_rows(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("name"))
    return panel.panel_json(rows, [F.col("id")])


@query(_PANEL + """ SELECT call_id, status, region, eligibility, priority, concat('<b>Chamada ', call_id, '</script>\\n') AS title FROM q""")
def panel_site(spark, d):
    """The panel published twice as scripts and a page, and the second one read back."""
    root = storage.scratch(spark, "site")
    title = F.concat(F.lit("<b>Chamada "), "call_id", F.lit("</script>\\n"))
    rows = storage.kept(_panel(spark, d).select("call_id", "status", "region", "eligibility", "priority", "days_left", title.alias("title")), "site")
    for part in (rows.filter("status = 'aberto'"), rows):
        site.publish(part, root, [*panel.order("default"), F.col("call_id")], "Editais", ["title", "status", "region"], 4000)
    return site.published(spark, root, rows.drop("days_left").schema)


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AS is_new FROM events")
def new_window(spark, d):
    return table(spark, d, "events").select("event_id", panel.is_new(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("is_new"))


# Runs


@query("""WITH r AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS number, count(*) FILTER (event_type = 'signup') AS n_new, count(*) AS n_total FROM events GROUP BY 1)
SELECT * FROM (SELECT number, n_new, n_total FROM r UNION ALL SELECT (SELECT max(number) FROM r) + 1, 7, 100) ORDER BY number DESC LIMIT 30""")
def run_log(spark, d):
    """The log's last thirty entries after one more run."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    runs = table(spark, d, "events").groupBy(day.cast("long").alias("number")).agg(F.max("ts").alias("at"), F.count_if(F.col("event_type") == "signup").alias("n_new"), F.count("*").alias("n_total"))
    return history.append_run(runs, F.lit("2024-02-01"), F.lit(7), F.lit(100)).drop("at")


_STATS = """s AS (SELECT s_suppkey AS source, s_acctbal > 0 AS ok, s_suppkey % 7 AS n_rows, s_suppkey % 3 AS n_new, s_suppkey % 2 AS n_updated, (s_suppkey % 100)::DOUBLE AS seconds FROM supplier)"""


def _source_stats(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("source"), (F.col("s_acctbal") > 0).alias("ok"), (k % 7).alias("n_rows"), (k % 3).alias("n_new"), (k % 2).alias("n_updated"), (k % 100).cast("double").alias("seconds"))


@query(f"WITH {_STATS} SELECT count(*) AS n_sources, count(*) FILTER (ok) AS n_ok, sum(n_rows)::BIGINT AS n_rows, sum(n_new)::BIGINT AS n_new, sum(n_updated)::BIGINT AS n_updated, coalesce(array_to_string(list_sort(list(source) FILTER (seconds >= 60)), ','), '') AS slow FROM s")
def run_totals(spark, d):
    return history.run_totals(_source_stats(spark, d)).withColumn("slow", F.array_join("slow", ","))


@query(f"WITH {_STATS} SELECT s_suppkey AS source, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT source FROM s WHERE NOT ok)")
def failed_sources(spark, d):
    return history.failed_sources(table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("name")), _source_stats(spark, d))


@query("""SELECT 'exact' AS asked, s_name AS name FROM supplier WHERE s_name = 'Supplier#000000001' AND s_suppkey % 4 <> 3
UNION ALL SELECT 'part', s_name FROM supplier WHERE contains(s_name, '02') AND s_suppkey % 4 <> 3 UNION ALL SELECT 'all', s_name FROM supplier WHERE s_suppkey % 4 <> 3""")
def source_selection(spark, d):
    """Sources that are on, asked for by a whole name, a part of one, and not at all."""
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 3, True).alias("disabled"))
    on = storage.active_sources(rows).select("name")
    asked = {"exact": " SUPPLIER#000000001 ", "part": "02", "all": ""}
    parts = [storage.select_sources(on, a).select(F.lit(k).alias("asked"), "name") for k, a in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Collection


@query("""SELECT s_suppkey AS page_id, 'selector' AS strategy, 'Edital numero ' || s_suppkey || '/' || k || ' de mobilidade' AS title, 'https://h.org/' || s_suppkey || '/' || k || '/edital.pdf' AS url, 'PDF' AS file, '10/10/2026' AS date_text, 'https://h.org/' || s_suppkey || '/' || k || '/anexo.doc=Anexo I' AS others FROM supplier, range(3) AS r(k) WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'scan', 'Programa de bolsas numero ' || s_suppkey || '/' || k, 'https://h.org/p/' || s_suppkey || '/' || k, '', '', '' FROM supplier, range(3) AS r(k) WHERE s_suppkey % 2 = 1""")
def listing_items(spark, d):
    """Blocks with attachments and share links on even pages; plain links, read by the fallback, on odd ones."""
    k = F.col("s_suppkey").cast("string")
    block = lambda i: F.concat(F.lit("<div class='accordion-item x'><h3>Edital numero "), k, F.lit(f"/{i} de mobilidade</h3><span class=d>10/10/2026</span><a href='/"), k, F.lit(f"/{i}/anexo.doc'>Anexo I</a><a href='/"), k, F.lit(f"/{i}/edital.pdf'>Baixar</a><a href='/"), k, F.lit(f"/{i}/edital.pdf'>Baixar</a><a href='https://www.facebook.com/sharer?u=1'>Compartilhe</a></div>"))
    plain = lambda i: F.concat(F.lit("<li><a href='/p/"), k, F.lit(f"/{i}'>Programa de bolsas numero "), k, F.lit(f"/{i}</a><a href='https://other.net/'>Outro portal qualquer</a>"))
    content = F.concat(F.lit("<html><body><ul>"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(*map(block, range(3)))).otherwise(F.concat(*map(plain, range(3)))), F.lit("</ul></body></html>"))
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit("https://www.h.org/list").alias("url"), content.alias("html"))
    found = extraction.listing_items(pages, "div.accordion-item", date_css=".d")
    url = F.regexp_replace("url", "//www.", "//")
    return found.select("page_id", "strategy", "title", url.alias("url"), "file", "date_text", F.regexp_replace(F.array_join(F.transform("attachments", lambda a: F.concat(a["url"], F.lit("="), a["label"])), ";"), "//www.", "//").alias("others"))


_COLLECT = _EVAL + f""", c AS (SELECT *, {_PRE} AS pre, {_N_AXES} > 0 AS has_axis FROM g),
k AS (SELECT *, pre >= 8 OR has_axis AS fit FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY NOT fit, pre DESC, call_id) AS place FROM k)"""
_WHY = "CASE WHEN NOT fit THEN 'not prequalified' WHEN NOT relevant THEN 'not relevant' WHEN status <> 'aberto' THEN 'status ' || status WHEN dl IS NULL THEN 'no confirmed deadline' ELSE 'accepted' END"


def _collected(spark, d):
    calls = X.calls(spark, d)
    url = F.concat(F.lit("https://h.org/"), "call_id")
    items = calls.select(F.col("source_no").alias("source"), F.col("call_id").alias("position"), F.concat(F.lit("Item "), "call_id").alias("title"), url.alias("url"), F.col("text").alias("context"))
    details = calls.filter("call_id % 4 = 0").select(url.alias("url"), "text")
    sources = calls.select(F.col("source_no").alias("source")).distinct().withColumn("max_details", F.lit(20))
    return collect.judged(items, sources, details, AS_OF)


@query(_COLLECT + f" SELECT source_no AS source, {_WHY} AS reason, count(*) AS n, count(*) FILTER (fit AND place <= 20 AND call_id % 4 = 0) AS n_read FROM p GROUP BY 1, 2")
def collect_discards(spark, d):
    return collect.discards(_collected(spark, d))


@query(_COLLECT + f" SELECT call_id AS position, source_no AS source, CAST(score AS INTEGER) AS score, dl AS deadline, CAST(place AS INTEGER) AS place FROM p WHERE {_WHY} = 'accepted'")
def collect_accepted(spark, d):
    """One whole run: candidates ranked, the best read, all judged, the accepted kept."""
    return collect.accepted(_collected(spark, d)).select("position", "source", F.col("score").cast("int").alias("score"), "deadline", "place")


@query(_COLLECT + f" SELECT call_id AS position, CAST(row_number() OVER (ORDER BY score DESC, pre DESC, call_id) AS INTEGER) AS place FROM p WHERE {_WHY} = 'accepted' QUALIFY row_number() OVER (ORDER BY score DESC, pre DESC, call_id) <= 50")
def accepted_by_fit(spark, d):
    """The run's report: the first fifty accepted calls, best fit first."""
    top = collect.by_fit(_collected(spark, d)).select("position", "score", "pre_score", "url").limit(50)
    w = Window.orderBy(F.col("score").desc(), F.col("pre_score").desc(), "position", "url")
    return top.select("position", F.row_number().over(w).alias("place"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every call evaluated, with its eligibility and priority."""
    return _panel(spark, d).select("call_id", "status", "deadline", "days_left", "confidence", "score", "relevant", "active", "axis_keys", "themes", "audience", "eligibility", "priority")
