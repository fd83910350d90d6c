"""The history kept in buckets of keys: a run reads narrow columns of all, and rewrites the buckets that it changes.

A commit (``storage.commit``) names each bucket's folder, the columns, the run and the
sources that the run has finished. What a run does not change stays where it is; a run
that fails leaves the last commit; one that is started again goes on with the
sources that are not finished yet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callscope.operators import history as H
from callscope.sources import storage

#: Buckets of a new ledger; it keeps its number.
BUCKETS = 64
_BUCKET = "__bucket"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The records of the newest commit, or of some of its buckets; columns that a bucket is older than are null."""
    _, says = storage.latest(spark, root)
    return _read(spark, says, buckets)


def _read(spark: SparkSession, says: dict, buckets: Iterable[int] | None = None) -> DataFrame:
    if not says:
        return spark.createDataFrame([], H.SCHEMA)
    wanted = says["paths"] if buckets is None else {str(b) for b in buckets} & says["paths"].keys()
    schema = StructType.fromJson(says["schema"])
    paths = [says["paths"][b] for b in sorted(wanted)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def record(spark: SparkSession, root: str, batch: DataFrame, run: int, ok_sources: DataFrame | None = None, buckets: int = BUCKETS, done: str | None = None) -> dict:
    """Upsert one run's rows (``history.upsert``) and commit; gives what the commit says.

    Rewritten are the buckets of the batch's keys and those with open records of answered
    sources that the batch has not seen; earlier editions are looked up in the titles of
    all. ``done`` notes a source as finished. A writer that has been overtaken gets ``Conflict``.
    """
    number, says = storage.latest(spark, root)
    count = says.get("buckets", buckets)
    whole, batch = _read(spark, says), storage.kept(batch, "batch")
    open_rows = whole.filter("status = 'aberto'").select("key", "source")
    if ok_sources is not None:
        open_rows = open_rows.join(ok_sources.select("source").distinct(), "source", "left_semi")
    unseen = open_rows.select("key").join(batch.select("key"), "key", "left_anti")
    # A bucket's number is all that comes to the driver.
    touched = sorted(r["b"] for r in batch.select("key").unionByName(unseen).select(_bucket(count).alias("b")).distinct().collect())
    after = H.upsert(_read(spark, says, touched), batch, run, ok_sources, titles=whole)
    paths, schema = dict(says.get("paths", {})), says.get("schema")
    if touched:
        folder = f"{root.rstrip('/')}/data/run-{run}-{uuid.uuid4().hex}"
        after.withColumn(_BUCKET, _bucket(count)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        context, path = storage._files(spark, folder)
        names = [f.getPath().getName() for f in context.util().listStatus(path)]
        paths |= {n.removeprefix(f"{_BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(_BUCKET)}
        schema = json.loads(after.schema.json())
    finished = [*(says.get("done", []) if says.get("run") == run else []), *([done] if done else [])]
    says = {"buckets": count, "schema": schema, "paths": paths, "run": run, "done": finished}
    storage.commit(spark, root, says, number)
    return says


def record_by_source(spark: SparkSession, root: str, batches: Iterable[tuple[str, DataFrame]], run: int, buckets: int = BUCKETS) -> list[str]:
    """A run source after source, one commit each; sources that this run has finished before are skipped. Gives those that were read now.

    A source's open records that its batch has not seen are demoted at its turn, so that a
    call which only a later source lists is demoted first and judged anew then.
    """
    read_now = []
    for source, batch in batches:
        _, says = storage.latest(spark, root)
        if says.get("run") == run and source in says.get("done", []):
            continue
        record(spark, root, batch, run, spark.createDataFrame([(source,)], "source string"), buckets, source)
        read_now.append(source)
    return read_now
