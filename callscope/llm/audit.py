"""Filter interaction audit: what each filter removes in every order of filters.

1. Rows are range-sorted by text fingerprint, full text and doc_id. A task reads its
   range in order, compares each row with its predecessors of equal text and notes the
   filters that the row fails as a mask. A range may begin or end inside a group of equal
   texts: the first and the last fingerprint's groups of every range give a boundary row
   with their text and least doc_id, and these (a few a range) are merged into the
   group's least doc_id, so that a group may span any number of tasks.
2. Masks are counted by part, mask and label; every figure of every order is a sum over
   those counters (at most 32 a part), so no order reads the documents again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded, materialise, table, text_or_empty

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
#: Groups of a range have numbers below this.
_GROUPS = 1 << 40


def failures(text: str) -> int:
    """The filters of one text that need no other text, as bits: A 1, B 2, C 4, D 8."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    short = len(words) < 200
    repetitive = 100 * len(set(words)) < 50 * len(words)
    shouting = 100 * (len(data) - len(data.translate(None, _UPPER))) > 3 * len(text)
    marked = len(data.translate(None, _MARKS)) < len(data)
    return short | repetitive << 1 | shouting << 2 | marked << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, in order -> a row each, then a boundary row for every text of the first and last fingerprint.

    A group is a text's rows in this range. ``least`` is the group's least doc_id here and
    ``mask`` lacks the duplicate's bit where an earlier range may still change it.
    """
    base = TaskContext.get().partitionId() * _GROUPS
    group, current, text, own = -1, None, None, 0
    open_groups: list[tuple[int, str, int | None]] = []  # of the fingerprint that is being read
    least, first = None, True

    def boundary(rows) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(columns[0], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[1], pa.string())], names=["doc_id", "part", "mask", "grp", "least", "text"])

    for batch in batches:
        masks, groups, leasts = [], [], []
        for fp, doc, t in zip(batch["fp"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
            now = t.as_py()
            if fp != current or now != text:
                if group >= 0:
                    open_groups.append((base + group, text, least))
                if fp != current:
                    if first and group >= 0:
                        yield boundary(open_groups)
                        first = False
                    open_groups = []
                group, current, text, least, own = group + 1, fp, now, doc, failures(now)
            masks.append(own)
            groups.append(base + group)
            leasts.append(least)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(masks, pa.int32()), pa.array(groups, pa.int64()), pa.array(leasts, pa.int64()), pa.nulls(len(masks), pa.string())], names=["doc_id", "part", "mask", "grp", "least", "text"])
    if group >= 0:
        yield boundary([*open_groups, (base + group, text, least)])


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, part, mask: a row for each row.

    Bits of mask are the filters in alphabetical order. A null text counts as empty, a
    null lang is the part ''. A row without doc_id is no smaller and no larger than any
    other: it never fails E. Rows that repeat doc_id and text fail E if a smaller doc_id
    has the text. An empty table gives none; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("text"))
    # Not by text, as Spark samples the range's keys into the driver. The order of rows is by all three all the same.
    ranged = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", F.col("doc_id").asc_nulls_last())
    ordered = ranged.sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    read = materialise(ordered.transform(bounded).mapInArrow(_masks, "doc_id long, part string, mask int, grp long, least long, text string"), "masks")
    edge = read.filter("text IS NOT NULL").select("grp", "text", F.col("least").alias("edge"))
    # Few rows a range: broadcast whatever Spark takes them for.
    spans = edge.groupBy("text").agg(F.min("edge").alias("over")).join(edge, "text").select("grp", "over")
    spans = F.broadcast(materialise(spans, "spans"))
    whole = read.filter("text IS NULL").join(spans, "grp", "left").select("doc_id", "part", "mask", F.least("least", "over").alias("least"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return whole.select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask), (doc_id, quality, toxic) -> part, mask, n, good, toxic: additive over any split of the rows."""
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = masks.join(marked, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _summed(fits, value=lambda c: c["n"]) -> Column:
    return F.aggregate("masks", F.lit(0).cast("long"), lambda total, c: total + F.when(fits(c), value(c)).otherwise(F.lit(0).cast("long")))


def interactions(counts: DataFrame) -> DataFrame:
    """Counters -> a row a part, order and step, from a part's 32 counters at most.

    In the 120 orders a filter comes first among the m filters that a document fails in
    120 / m of them: that is the document's share of the filter's ``shapley``.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic", F.bit_count("mask").alias("m"))).alias("masks"))
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, i + 1, bits[f], sum(bits[g] for g in o[:i])) for o in ORDERS for i, f in enumerate(o)]
    listed = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"e":{e}}}' for o, s, b, e in steps) + "]"), "array<struct<o: string, s: int, b: int, e: int>>")
    rows = parts.select("part", "masks", F.explode(listed).alias("x"))
    own = lambda c: c["mask"].bitwiseAND(F.col("x.b")) != 0
    before = lambda c: c["mask"].bitwiseAND(F.col("x.e")) != 0
    removed = lambda c: own(c) & ~before(c)
    return rows.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        _summed(lambda c: ~own(c) & ~before(c)).alias("kept"),
        _summed(removed).alias("removed"),
        _summed(lambda c: own(c) & before(c)).alias("redundant"),
        _summed(lambda c: c["mask"] == F.col("x.b")).alias("unique_fails"),
        _summed(removed, lambda c: c["good"]).alias("good_lost"),
        _summed(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        _summed(own, lambda c: (c["n"] * F.lit(len(ORDERS)) / c["m"]).cast("long")).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all orders of the five filters over every whole text of ``documents``."""
    return interactions(counters(failure_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS e
  FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(ws) < 200,
    'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': e} AS x
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END)
         || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails
  FROM f
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), firsts AS (
  -- the step at which a document goes, 6 if at none
  SELECT part, fails, n, good, toxic, filter_order,
         coalesce(list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))) , 6) AS gone
  FROM c, orders WHERE fails <> ''
  UNION ALL
  SELECT part, fails, n, good, toxic, filter_order, 6 FROM c, orders WHERE fails = ''
), steps AS (
  SELECT *, filter_order[step] AS letter FROM firsts, (SELECT unnest(range(1, 6)) AS step)
), s AS (
  SELECT part, filter_order, step, any_value(letter) AS letter,
         sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < step AND contains(fails, letter) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step
), sh AS (
  SELECT part, letter, sum(removed) AS shapley FROM s GROUP BY part, letter
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM s JOIN sh USING (part, letter)
"""
