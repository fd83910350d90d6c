"""Mixing sources to target weights with hash-threshold histograms, no sort of documents.

A document's place in its source is a 60-bit hash of its id. A source's target
is ``k`` whole copies of everything plus a budget below one copy; the budget is
met by a hash threshold, so smaller budgets take a subset of what larger ones
take. Words are summed by source and the hash's top 12 bits; a running sum over
those 4,096 buckets finds the one in which the budget ends, and only that bucket
is read again with the next 12 bits, down to the single hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import materialise, table, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
HASH_BITS, STEP_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of MD5 of the id as text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size long) -> and target double.

    Sources in code-point order, null last, take the weights in turn. A target
    stops at ``cap`` times its source; what is over is shared again by weight.
    That fixed point has every uncapped source at one common level a weight unit:
    with sources ordered by cap per weight, the first whose cap is above the level
    that the rest would get sets it. One row a source goes through the window.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = totals.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights)))))
    line = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn("above", F.col("source_size") * F.lit(float(cap)) / F.col("weight") > F.col("level"))
    common = F.min(F.when(F.col("above"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(every)["level"]
    capped = F.col("source_size") * F.lit(float(cap))
    return rows.withColumn("common", common).select("source", "source_size", F.when(F.col("common").isNull(), capped).otherwise(F.least(capped, F.col("common") * F.col("weight"))).alias("target"))


def _boundaries(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Per source the hash in which the budget ends and whether it is still taken."""
    state = plans.filter("source_size > 0").select("source", "extra", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        ends = state.withColumnRenamed("source", "of")
        inside = rows.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + STEP_BITS) == F.col("prefix"))).drop("of")
        if shift == HASH_BITS - 2 * STEP_BITS:
            rows = materialise(inside.select("source", "hash", "size"), "boundary")
            inside = rows.join(ends, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        sums = inside.groupBy("source", "extra", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        found = sums.withColumn("upto", F.col("below") + upto).filter("upto > extra")
        state = found.groupBy("source").agg(F.min_by(F.struct("extra", "bucket", "upto", "words"), "bucket").alias("b"))
        state = state.select("source", F.col("b.extra").alias("extra"), F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("below"), F.col("b.words").alias("words"))
        state = materialise(state, "thresholds")
        if shift:
            state = state.drop("words")
    take = 2 * (F.col("extra") - F.col("below")) >= F.col("words")
    return state.select("source", (F.col("prefix") - F.when(take, 0).otherwise(1)).alias("threshold"))


def source_plans(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Sized rows (source, size, hash) -> a row a source: of, source_size, target, whole, extra, threshold."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plans = source_targets(totals, weights, share, cap).withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    plans = materialise(plans, "targets")
    ends = _boundaries(rows, plans).withColumnRenamed("source", "of")
    plans = plans.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return materialise(plans.withColumnRenamed("source", "of"), "plans")


def _sized(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text_or_empty()).alias("size"), hash_of(F.col("doc_id")).alias("hash")), "sizes")


def _copies(whole: Column, extra: Column, threshold: Column, place: Column) -> Column:
    return (whole + F.when((extra > 0) & (place <= F.coalesce(threshold, F.lit(-1))), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Documents (doc_id, source, text) -> (doc_id, source, size, source_size, target, copies).

    ``copies`` is how often the mix takes the document, 0 to ``cap``. The document
    in which a budget ends is taken if that brings the source nearer to its
    target. Null texts have size 0; a null source is a source of its own; repeated
    rows and equal ids fall on the same side of the threshold; an empty table
    gives an empty result; further columns are ignored. Reruns agree, as the hash
    depends on the id alone.
    """
    rows = _sized(docs)
    placed = rows.join(source_plans(rows, weights, share, cap), F.col("source").eqNullSafe(F.col("of")))
    return placed.select("doc_id", "source", "size", "source_size", "target", _copies(*map(F.col, ("whole", "extra", "threshold", "hash"))).alias("copies"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: every row as often as it is taken, its columns unchanged.

    A filter on each row's own hash against its source's threshold: the texts meet
    the one-row-a-source plans only (which Spark broadcasts where their written
    size allows it) and are neither joined by id nor sorted.
    """
    plans = source_plans(_sized(docs), weights, share, cap)
    plans = plans.select(F.col("of").alias("__of"), *[F.col(c).alias(f"__{c}") for c in ("whole", "extra", "threshold")])
    rows = docs.withColumns({"__source": F.col("source").cast("string"), "__hash": hash_of(F.col("doc_id"))})
    rows = rows.join(plans, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__copies", _copies(*map(F.col, ("__whole", "__extra", "__threshold", "__hash")))).filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM t
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - (2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w
), c AS (
  SELECT *, (SELECT arg_min(level, source_size::DOUBLE / weight) FROM l WHERE source_size * 2.0::DOUBLE / weight > level) AS common FROM l
), p AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, common * weight) END AS target FROM c
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p
), e AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, target - whole * source_size AS extra,
         sum(size) OVER (PARTITION BY d.source ORDER BY h)::DOUBLE AS upto,
         sum(size) OVER (PARTITION BY d.source, h)::DOUBLE AS words
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN source_size > 0 AND (upto <= extra OR (upto - words <= extra AND 2 * (extra - (upto - words)) >= words)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""
