"""Reading configuration and state, writing results, cutting lineage."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str | None:
    """A fresh path in the folder that the cluster names in ``spark.checkpoint.dir``; None where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}" if base else None


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared checkpoint folder and read back.

    Without such a folder a session in one process caches instead; on a cluster that
    is an error, as lineage would grow from round to round.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    if path is None:
        if not _one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return df.cache()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder; a session in one process may do without and gets one below its warehouse."""
    path = shared_path(spark, label)
    if path is None and not _one_process(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _one_process(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def config(defaults: dict, overrides: dict | None) -> dict:
    """Overrides on defaults; keys that begin with ``_`` are notes."""
    return defaults | {k: v for k, v in (overrides or {}).items() if not k.startswith("_")}


def effective_config(sources: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(source, overrides map<string,string>) -> source, key, value: ``config`` for every source, as rows; null overrides change nothing."""
    own = F.map_filter(F.coalesce("overrides", F.create_map().cast("map<string,string>")), lambda k, _: ~F.startswith(k, F.lit("_")))
    under = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else F.create_map().cast("map<string,string>")
    kept_under = F.map_filter(under, lambda k, _: ~F.map_contains_key(own, k))
    return sources.select("source", F.explode(F.map_concat(kept_under, own)))


def read_json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows, an empty table if the path is missing; corrupt rows are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(~F.coalesce("disabled", F.lit(False)))


def select_sources(sources: DataFrame, asked: str | None) -> DataFrame:
    """By exact name if any has it, else by part of the name; blank takes all. Case does not count."""
    wanted = (asked or "").strip().lower()
    if not wanted:
        return sources
    near = sources.filter(F.contains(F.lower("name"), F.lit(wanted))).withColumn("__exact", F.lower("name") == wanted)
    any_exact = F.max("__exact").over(Window.partitionBy(F.lit(0)))  # sources are few
    return near.withColumn("__any", any_exact).filter(F.col("__exact") | ~F.col("__any")).drop("__exact", "__any")


class Conflict(RuntimeError):
    """Another writer has committed first."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path(path)


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The newest commit of a state: its number and what it says; (0, {}) if there is none."""
    context, folder = _files(spark, f"{root.rstrip('/')}/commits")
    if not context.util().exists(folder):
        return 0, {}
    numbers = [int(f.getPath().getName()) for f in context.util().listStatus(folder) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    lines = spark.read.text(f"{root.rstrip('/')}/commits/{max(numbers)}", wholetext=True).first()
    return max(numbers), json.loads(lines["value"])


def put(spark: SparkSession, path: str, text: str) -> str:
    """Write a small new file, with its folders; returns its path."""
    context, target = _files(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.CreateOpts, 1)
    options[0] = hadoop.Options.CreateOpts.createParent()
    out = context.create(target, spark.sparkContext._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE), options)
    try:
        out.write(text.encode())
    finally:
        out.close()
    return path


def renumbered(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Rename the data files of a written folder by their order: 00001, 00002, ...; empty ones and marks stay out of the list."""
    context, path = _files(spark, folder)
    files = [(f.getPath().getName(), f.getPath()) for f in context.util().listStatus(path) if f.getLen()]
    data = [old for name, old in sorted(files, key=lambda f: f[0]) if name.startswith("part-")]
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    names = [f"{i:05d}{suffix}" for i in range(1, len(data) + 1)]
    for old, name in zip(data, names):
        context.rename(old, _files(spark, f"{folder}/{name}")[1], none)
    return names


def commit(spark: SparkSession, root: str, says: dict, after: int) -> int:
    """Make ``says`` the commit after number ``after``.

    The text is written beside and renamed to its number, which fails if the number is
    taken: of writers that start from one state one gets through, the others raise
    ``Conflict``. Commits are never changed, so that readers see the old state or the new one, whole.
    """
    folder = f"{root.rstrip('/')}/commits"
    context, target = _files(spark, f"{folder}/{after + 1}")
    source = _files(spark, put(spark, f"{folder}/.{uuid.uuid4().hex}", json.dumps(says)))[1]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    none[0] = getattr(hadoop.Options.Rename, "NONE")
    try:
        context.rename(source, target, none)
    except Py4JJavaError as e:
        context.delete(source, False)
        if "FileAlreadyExists" in str(e.java_exception) or context.util().exists(target):
            raise Conflict(f"commit {after + 1} of {root} is taken") from e
        raise
    return after + 1


def swap_in(df: DataFrame, root: str, version: str, after: int | None = None, **says) -> str:
    """Write a new version beside the old ones, then commit it: a failure in between leaves the old state.

    ``after``: the commit that the version was made from (the newest if null); ``says`` is noted with it.
    """
    spark = df.sparkSession
    after = latest(spark, root)[0] if after is None else after
    path = f"{root.rstrip('/')}/v-{version}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    commit(spark, root, {"path": path, **says}, after)
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The state of the newest commit."""
    number, says = latest(spark, root)
    if not number:
        raise FileNotFoundError(f"{root} has no commit")
    return spark.read.parquet(says["path"])
