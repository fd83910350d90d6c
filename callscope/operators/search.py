"""Search of the panel's rows through an index of trigrams that grows run by run.

A gram's postings name blocks of keys, not keys: texts that are alike share most of
their grams, so a block has few more than one of its texts. What a block holds is
read and compared, so a search finds what a scan finds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.text import strip_accents
from callscope.sources import storage

#: Trigrams whose postings are intersected: the rarest of a search; ``contains`` decides about what is left.
RAREST = 3
#: Folders of the kept texts; a search reads those that its candidates lie in.
PARTS = 64
#: Blocks of keys in a folder, by the key's hash, the same in every run.
BLOCKS = 1 << 8


def comparable(text: Column) -> Column:
    """Accents and case do not count."""
    return F.lower(strip_accents(text))


def searched_text(title: Column, source: Column, region: Column, why: Column, axes: Column, themes: Column, restrictions: Column, audience: Column) -> Column:
    """The eight searched fields as one text: lists by their members, restrictions by programme and requirement; nulls are left out."""
    asked = F.transform(restrictions, lambda r: F.concat_ws(" ", r["programme"], r["requires"]))
    return F.concat_ws(" ", title, source, region, why, axes, themes, asked, audience)


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in time that grows with its length; none of a shorter or null one."""

    # Each match is one character, which keeps pairs of surrogates together, and looks at the two behind it.
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)(?=(...))."), F.lit(1)))


def _places(key: Column) -> dict[str, Column]:
    """The folder and the block of a key."""
    place = F.pmod(F.xxhash64(key), F.lit(PARTS * BLOCKS))
    return {"part": (place % PARTS).cast("int"), "block": F.floor(place / PARTS).cast("int")}


def extend(rows: DataFrame, root: str, key: str, text: str) -> int:
    """Add a run's rows to the index at ``root``; returns the commit's number.

    A row replaces earlier ones of its key, a null text takes its key out. Of rows of one
    key in one run the greatest text counts. Rows of null keys are left out. A run that fails
    before its commit leaves nothing that a search reads; of two writers one gets ``Conflict``.
    """
    spark = rows.sparkSession
    number, says = storage.latest(spark, root)
    return _add(rows.select(F.col(key).alias("key"), comparable(F.col(text)).alias("text")), root, number, says.get("runs", []))


def compact(spark: SparkSession, root: str) -> int:
    """One run of the newest texts in place of all; searches find what they found."""
    number, says = storage.latest(spark, root)
    return _add(_newest(_read(spark, root, "texts", says)).filter("text IS NOT NULL"), root, number, []) if number else 0


def _add(rows: DataFrame, root: str, number: int, runs: list[str]) -> int:
    spark, root, run = rows.sparkSession, root.rstrip("/"), f"{number + 1:09d}-{uuid.uuid4().hex}"
    newest = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("text").alias("text"))
    texts = newest.withColumn("part", _places(F.col("key"))["part"])
    # Ranges by part and block: a folder's rows are few files, a large folder is more than one task, and a block's texts lie together.
    texts.repartitionByRange("part", _places(F.col("key"))["block"], "key").write.partitionBy("part").parquet(f"{root}/texts/run={run}")
    kept = spark.read.schema(texts.schema).parquet(f"{root}/texts/run={run}").withColumn("block", _places(F.col("key"))["block"])
    blocks = kept.select(F.explode(grams(F.col("text"))).alias("gram"), "part", "block").distinct()
    # Sorted by gram, so that the files' statistics leave out all but a search's grams; a gram of very many blocks spans ranges.
    blocks.repartitionByRange("gram", "part", "block").sortWithinPartitions("gram", "part", "block").write.parquet(f"{root}/blocks/run={run}")
    counted = spark.read.schema(blocks.schema).parquet(f"{root}/blocks/run={run}").groupBy("gram").agg(F.count("*").alias("n"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/counts/run={run}")
    return storage.commit(spark, root, {"runs": [*runs, run], "key": rows.schema["key"].dataType.simpleString()}, number)


#: Columns of the three tables; runs that wrote no row leave folders without a schema.
_COLUMNS = {"texts": "key {key}, text string, run string, part int", "blocks": "gram string, part int, block int, run string", "counts": "gram string, n long, run string"}


def _read(spark: SparkSession, root: str, what: str, says: dict) -> DataFrame:
    """The committed runs of a table; folders of failed ones are not named."""
    base = f"{root.rstrip('/')}/{what}"
    return spark.read.schema(_COLUMNS[what].format(key=says["key"])).option("basePath", base).parquet(*[f"{base}/run={r}" for r in says["runs"]])


def _newest(texts: DataFrame) -> DataFrame:
    return texts.groupBy("key").agg(F.max_by("text", "run").alias("text"))


def search(spark: SparkSession, root: str, asked: str) -> DataFrame:
    """(key) of the rows whose text contains ``asked``: the rows that a scan of all texts finds.

    Candidates are the blocks that hold the rarest trigrams of the search in one run; their
    texts are read and compared, and of each key the newest counts. A blank search finds every row, one below three characters scans the texts.
    """
    number, says = storage.latest(spark, root)
    if not number:
        raise FileNotFoundError(f"{root} has no index")
    needle, wanted = spark.range(1).select(comparable(F.lit(asked.strip())), grams(comparable(F.lit(asked.strip())))).first()
    texts = _read(spark, root, "texts", says)
    if wanted:
        texts = _of_candidates(texts, _read(spark, root, "blocks", says), _rarest(_read(spark, root, "counts", says), wanted))
    # The verdict goes through the shuffle, not the text.
    hits = texts.select("key", "run", F.contains("text", F.lit(needle)).alias("hit"))
    return hits.groupBy("key").agg(F.max_by("hit", "run").alias("hit")).filter("hit").select("key")


def _rarest(counts: DataFrame, wanted: list[str]) -> list[str]:
    """At most ``RAREST`` of a search's grams; one that no row has comes first and leaves no candidate."""
    # One row a gram of the search at most.
    seen = {r.gram: r.n for r in counts.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    return sorted(wanted, key=lambda g: (seen.get(g, 0), g))[:RAREST]


def _of_candidates(texts: DataFrame, blocks: DataFrame, chosen: list[str]) -> DataFrame:
    """All runs' texts of the blocks that have the chosen grams in one run; other parts' folders are not read where the candidates are broadcast."""
    shared = blocks.filter(F.col("gram").isin(chosen)).groupBy("run", "part", "block").agg(F.count("*").alias("n"))
    candidates = shared.filter(F.col("n") == len(chosen)).select("part", "block").distinct()
    return texts.withColumn("block", _places(F.col("key"))["block"]).join(candidates, ["part", "block"], "left_semi")
