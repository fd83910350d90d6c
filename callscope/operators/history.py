"""Run-over-run state keyed by url: upsert, change detection, editions, demotion, novelty.

A record has the columns of ``SCHEMA`` and whatever else the runs' rows carry (themes,
points, deadline, attachments and so on). An update takes the new value of every such
column but those of ``FIRST``, which stay as first seen, and of ``attachments``, which an
empty list does not replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.text import signature
from callscope.operators.entity import previous_editions
from callscope.sources import storage

SCHEMA = "key long, title string, status string, source string, first_run long, last_run long, changed_run long, changes array<string>, new_edition_of string, previous_year int, entry long"
FIRST = ("source", "region", "date_text", "edition_year", "first_seen")
LOST = "aberto -> verificar (not found)"
WARNING = "not found in the last run"
_CORE = ("key", "title", "status", "source")
_OWN = ("first_run", "last_run", "changed_run", "changes", "new_edition_of", "previous_year", "entry")


def changes(old_title: Column, new_title: Column, old_status: Column, new_status: Column) -> Column:
    """What changed: the title only if its signature differs, the status if it differs."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    title = full(old_title) & full(new_title) & (old_title != new_title) & (signature(old_title) != signature(new_title))
    status = full(old_status) & full(new_status) & (old_status != new_status)
    return F.array_compact(F.array(F.when(title, "title changed"), F.when(status, F.concat_ws("", F.lit("status: "), old_status, F.lit(" to "), new_status))))


def collapsed(batch: DataFrame) -> DataFrame:
    """One row a key: the last by ``position``, with the first source, position and turn of the key's rows.

    Of rows of one key and position that of the least ``__line`` counts, where the rows have
    that column (as of ``fixtures.numbered``), else any; it is not part of the result.
    """
    own = [c for c in batch.columns if c != "__line"]
    every = F.struct(*[F.col(f"`{c}`") for c in own])
    line = ["__line"] if "__line" in batch.columns else []
    placed = lambda at: F.when(F.col("position").isNotNull(), F.struct(at, *line))
    turn = F.min("turn") if "turn" in batch.columns else F.lit(None)
    found = batch.groupBy("key").agg(F.min_by(every, placed(-F.col("position"))).alias("last"), F.min_by("source", placed(F.col("position"))).alias("source"), F.min("position").cast("long").alias("position"), turn.cast("long").alias("turn"))
    rest = [f"last.{c}" for c in own if c not in ("key", "source", "position", "turn")]
    return found.select("key", "source", "position", "turn", *rest)


def upsert(history: DataFrame, batch: DataFrame, run: int, ok_sources: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(history, one run's rows (key, title, status, source, position, ...)) -> history'.

    The rows of a key are collapsed first, by ``position``, which tells the order in
    which the run met them; a batch whose keys are distinct may come without. One full
    outer join. Seen rows take the new values; new rows are inserted, with the earlier
    edition that they continue, if the history or an earlier row of the batch has one.
    Open rows of a source that answered (``ok_sources``, all if null) but were not seen
    become ``verificar``. With a ``turn`` in ``ok_sources`` and the batch (the order of
    the sources) a row that only a later source lists is demoted at its own source's
    turn and judged from there, as a run in that order does. ``titles``: the records among
    which earlier editions are looked for, where ``history`` is a part of them.
    """
    if "position" not in batch.columns:
        new = batch.withColumns({"position": F.lit(0).cast("long"), "turn": F.lit(None).cast("long")})
    else:
        new = collapsed(batch)
    carried = [c for c in new.columns if c not in (*_CORE, "position", "turn")]
    new = new.select("key", *[F.col(c).alias(f"n_{c}") for c in (*_CORE[1:], "position", "turn", *carried)], F.lit(True).alias("seen"))
    rows = history.withColumn("known", F.lit(True)).join(new, "key", "full")
    if ok_sources is None:
        rows = rows.withColumns({"answered": F.lit(True), "o_turn": F.lit(None).cast("long")})
    else:
        turn = F.col("turn").cast("long") if "turn" in ok_sources.columns else F.lit(None).cast("long")
        rows = rows.join(ok_sources.select("source", F.lit(True).alias("answered"), turn.alias("o_turn")), "source", "left")
    seen, known = F.coalesce("seen", F.lit(False)), F.coalesce("known", F.lit(False))
    late = F.coalesce(F.col("n_turn") > F.col("o_turn"), F.lit(False))
    lost = known & (F.col("status") == "aberto") & F.coalesce("answered", F.lit(False)) & (~seen | late)
    rows = rows.withColumn("lost", lost)
    before = F.when(F.col("lost"), "verificar").otherwise(F.col("status"))
    diff = F.when(seen & known, changes(F.col("title"), F.col("n_title"), before, F.col("n_status"))).otherwise(F.array().cast("array<string>"))
    old = F.coalesce("changes", F.array().cast("array<string>"))
    grown = F.when(F.array_contains(old, LOST), old).otherwise(F.concat(old, F.array(F.lit(LOST))))
    last_six = F.slice(grown, F.greatest(F.lit(1), F.size(grown) - 5), F.lit(6))
    kept = {c: F.when(seen & ~known, F.col(f"n_{c}")).otherwise(F.col(c)) if c in history.columns else F.when(~known, F.col(f"n_{c}")) for c in carried if c in FIRST}
    taken = {c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)) if c in history.columns else F.col(f"n_{c}") for c in carried if c not in FIRST}
    if "attachments" in taken and "attachments" in history.columns:
        taken["attachments"] = F.when(seen & (F.coalesce(F.size("n_attachments"), F.lit(0)) > 0), F.col("n_attachments")).otherwise(F.col("attachments"))
    if "warnings" in taken and "warnings" in history.columns:
        told = F.coalesce("warnings", F.array().cast("array<string>"))
        taken["warnings"] = F.when(seen, F.col("n_warnings")).when(F.col("lost"), F.array_union(told, F.array(F.lit(WARNING)))).otherwise(F.col("warnings"))
    now = F.lit(run).cast("long")
    rows = rows.withColumn("diff", diff).select(
        "key",
        F.when(seen & (F.coalesce("n_title", F.lit("")) != ""), F.col("n_title")).otherwise(F.col("title")).alias("title"),
        F.when(seen, F.col("n_status")).otherwise(before).alias("status"),
        F.coalesce("source", "n_source").alias("source"),
        F.coalesce("first_run", now).alias("first_run"),
        F.when(seen, now).otherwise(F.col("last_run")).alias("last_run"),
        F.when((F.size("diff") > 0) | F.col("lost"), now).otherwise(F.col("changed_run")).alias("changed_run"),
        F.when(F.size("diff") > 0, F.col("diff")).when(F.col("lost"), last_six).otherwise(old).alias("changes"),
        "new_edition_of",
        "previous_year",
        F.coalesce("entry", F.col("n_position")).alias("entry"),
        *[v.alias(c) for c, v in (kept | taken).items()],
        *[c for c in history.columns if c not in (*_CORE, *_OWN, *carried)],
    )
    fresh = new.join(history.select("key"), "key", "left_anti").select("key", F.col("n_title").alias("title"), F.struct(now.alias("first_run"), F.col("n_position").alias("entry")).alias("place"))
    known = (history if titles is None else titles).select("key", "title", F.struct("first_run", "entry").alias("place"))
    # Inserted rows with the edition that they continue; titles without a year have none.
    found = previous_editions(storage.kept(fresh, "fresh"), known, url="key", order="place", earlier=True, own=True).filter("previous_url is not null")
    found = found.select("key", F.col("previous_url").cast("string").alias("__of"), F.col("previous_year").alias("__year"))
    joined = rows.join(found, "key", "left").withColumns({"new_edition_of": F.coalesce("new_edition_of", "__of"), "previous_year": F.coalesce("previous_year", "__year")})
    return joined.select(*rows.columns)


def novelty(run: int, first_ever: bool = False) -> Column:
    fresh = F.lit("inicial" if first_ever else "novo")
    return (
        F.when(F.col("changed_run") == run, "atualizado").when(F.coalesce("new_edition_of", F.lit("")) != "", "nova_edicao").when(F.col("first_run").isNull() | (F.col("first_run") == run), fresh).when((F.col("first_run") == 1) & F.lit(run > 1), "inicial").otherwise("conhecido")
    )


def run_stats(batch: DataFrame, history: DataFrame, run: int) -> DataFrame:
    """Rows, new and updated ones of a run by source."""
    state = history.select("key", (F.col("first_run") == run).cast("int").alias("is_new"), (F.col("changed_run") == run).cast("int").alias("is_changed"))
    return batch.join(state, "key", "left").groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("is_new").alias("n_new"), F.sum("is_changed").alias("n_updated"))


RUNS = "number long, at timestamp, n_new long, n_total long"


def append_run(runs: DataFrame, at: Column, n_new: Column, n_total: Column, keep: int = 30) -> DataFrame:
    """The run log with the next run, its last ``keep`` entries (a log of fixed length)."""
    number = runs.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number"))
    grown = runs.unionByName(number.select("number", at.cast("timestamp").alias("at"), n_new.cast("long").alias("n_new"), n_total.cast("long").alias("n_total")))
    return grown.orderBy(F.col("number").desc()).limit(keep)


def run_totals(stats: DataFrame, slow: float = 60.0) -> DataFrame:
    """(source, ok, n_rows, n_new, n_updated, seconds) of a run -> its one-row summary with the slow sources by name."""
    return stats.agg(
        F.count("*").alias("n_sources"),
        F.count_if("ok").alias("n_ok"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_new").alias("n_new"),
        F.sum("n_updated").alias("n_updated"),
        F.sort_array(F.collect_list(F.when(F.col("seconds") >= slow, F.col("source")))).alias("slow"),
    )


def failed_sources(sources: DataFrame, stats: DataFrame) -> DataFrame:
    """The sources whose last run failed."""
    return sources.join(stats.filter(~F.col("ok")), "source", "left_semi")
