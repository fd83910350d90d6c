"""Quality rules: a threshold table compiled into one projection, native Spark only.

Words are runs of other than ASCII white space. All figures of a text come from
array and string functions in one select; no shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import table, text_or_empty

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the languages served; a parameter of ``assess``.
STOP_WORDS = ("the", "of", "and", "to", "in", "that", "is", "der", "die", "und", "in", "den", "das", "de", "la", "le", "et", "les", "des", "que", "el", "en", "los", "y", "del")

#: (rule, figure, least, greatest); null bounds are open. A text passes if every figure is inside.
THRESHOLDS = (
    ("length", "n_words", 10, None),
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.08),
    ("stop_words", "long_text_stop_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("repeated_words", "repeat_word_ratio", None, 0.2),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order.

    Sorting (hash, place) puts equal windows side by side; the places that have an
    equal neighbour, back in order, each add the words up to the next one.
    """

    def count(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda n, x: n + x))

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(pairs, count))


def figures(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id and all figures of the whole text."""
    text = F.col("text")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    n = F.size("words")
    hashes = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(_let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(hashes, _repeat_words).alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(dict.fromkeys(stop_words)) + r")(?![^\x20\x09-\x0D])")).cast("long").alias("n_stop_words"),
        F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[\x20\x09-\x0D]*(?:\n|\z)")).cast("long").alias("n_ellipsis_lines"),
        F.regexp_count(text, F.lit(r"(?:\A|\n)[\x20\x09-\x0D]*[-*•][\x20\x09]")).cast("long").alias("n_bullet_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        F.when(F.col("n_words") >= 100, ratio("n_stop_words", "n_words")).otherwise(F.lit(1.0)).alias("long_text_stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
    )


def compiled(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """The table as one verdict and one array of the rules that failed."""
    failed = [F.when(~((F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))), F.lit(rule)) for rule, c, low, high in thresholds]
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return F.size(names) == 0, names


def assess(docs: DataFrame, thresholds=THRESHOLDS, stop_words=STOP_WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, figures, failed_rules, base_failed, kept; a row for each row.

    A null or empty text has no words, fails on length and is not kept. Equal rows
    give equal rows; a null doc_id is carried; an empty table gives none; further
    columns are ignored.
    """
    passed, names = compiled(thresholds)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = figures(docs, stop_words).withColumn("base_failed", base)
    return rows.withColumn("failed_rules", names).withColumn("kept", ~F.col("base_failed") & passed)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: base figures and verdict of every document."""
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), p AS (
  SELECT rn, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5
), g AS (
  SELECT rn, i, count(*) OVER (PARTITION BY rn, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS c FROM p
), r AS (
  SELECT rn, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (
    SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM g WHERE c > 1
  ) GROUP BY rn
), b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(ws, lambda x: list_contains(['the','of','and','to','in','that','is','der','die','und','den','das','de','la','le','et','les','des','que','el','en','los','y','del'], lower(x)))) AS n_stop,
         len(regexp_extract_all(t, '(\.\.\.|…)[\x20\x09-\x0D]*(\n|\z)')) AS n_ellipsis,
         len(regexp_extract_all(t, '(\A|\n)[\x20\x09-\x0D]*[-*•][\x20\x09]')) AS n_bullet
  FROM w LEFT JOIN r USING (rn)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed
        AND word_chars / n_words BETWEEN 2.0 AND 14.0
        AND n_symbols <= 0.08 * word_chars
        AND (n_words < 100 OR n_stop / n_words >= 0.01)
        AND n_repeat_words / n_words <= 0.2
        AND n_dup_lines / n_lines <= 0.5
        AND n_ellipsis / n_lines <= 0.5
        AND n_bullet / n_lines <= 0.9) AS kept
FROM f
"""
