"""SimHash near-duplicates, linked through pivot distance tables.

Fingerprint: 64 majority bits over the XXH64 (seed 42) of all three-word shingles
of the ASCII-lower-cased text, repeats included; fewer words give one shingle of
what there is, no word gives fingerprint zero.

Linking works on the distinct fingerprints. The pivot table holds each one's Hamming
distances to ``BANDS`` families of ``FAMILY`` reference fingerprints. The references
of a family are alike outside one band of eight bits, so the differences between a
family's distances (its relative coordinates) depend on that band alone. The
references are drawn until they tell all 256 values of their band apart.

1. Fingerprints at most two bits apart differ in two bands at most: for six of the
   eight families all relative coordinates are equal. An equi-join on the coordinates
   of six families, for each of the 28 choices of six, meets every link. A bucket's
   members are equal in six bands, so it never has more than 65,536 of them,
   whatever the corpus, and all buckets are treated alike.
2. A pair is discarded if any of its ``len(CHECKED)`` further absolute coordinates
   differ by more than two (triangle inequality).
3. Survivors are verified by XOR and bit count. All of this happens inside the join;
   no discarded pair leaves it.
"""

from __future__ import annotations

import functools
import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded, materialise, table, text_or_empty
from callscope.llm.components import connected_components
from callscope.llm.resemblance import near_copies

DISTANCE = 2
BANDS, FAMILY = 8, 7
_WIDTH = 64 // BANDS


def _tell_apart(places: list[int]) -> bool:
    """Whether the differences between a value's distances to the places are another list for each value of a band."""
    first, *rest = places
    return len({tuple((x ^ p).bit_count() - (x ^ first).bit_count() for p in rest) for x in range(1 << _WIDTH)}) == 1 << _WIDTH


def _references() -> list[list[int]]:
    """The families: random references that share all bits outside their band and tell its values apart."""
    r = random.Random(8)
    out = []
    for band in range(BANDS):
        mask = ((1 << _WIDTH) - 1) << (_WIDTH * band)
        shared = r.getrandbits(64) & ~mask
        places = next(p for p in iter(lambda: r.sample(range(1 << _WIDTH), FAMILY), None) if _tell_apart(p))
        out.append([shared | at << (_WIDTH * band) for at in places])
    return out


PIVOTS = _references()
#: The references whose absolute distances go along with each row of the join: two of each family.
CHECKED = [p for family in PIVOTS for p in family[:2]]
CHOICES = list(itertools.combinations(range(BANDS), BANDS - DISTANCE))

_digest = functools.partial(xxhash.xxh64_digest, seed=42)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digests = np.frombuffer(b"".join(map(_digest, shingles)), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        votes += np.unpackbits(digests[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(digests)).tobytes(), "big")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _fingerprints(batches):
    for batch in batches:
        names = batch.schema.names
        fps = pa.array([_signed(fingerprint(t)) for t in batch.column(names.index("text")).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(i) for i, n in enumerate(names) if n != "text"] + [fps], names=[n for n in names if n != "text"] + ["fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long)."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.transform(bounded).mapInArrow(_fingerprints, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("long")


def _packed(values: list[Column], bits: int) -> Column:
    out = F.lit(0).cast("long")
    for i, value in enumerate(values):
        out = out.bitwiseOR(F.shiftleft(value, bits * i))
    return out


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp long) -> fp, p0, p1 (absolute coordinates, a byte each), families (relative coordinates, one long a family)."""
    fp = F.col("fp")
    half = len(CHECKED) // 2
    relative = [_packed([_distance(fp, p) - _distance(fp, first) + 64 for p in rest], 8) for first, *rest in PIVOTS]
    return fps.select("fp", *[_packed([_distance(fp, p) for p in part], 8).alias(c) for c, part in (("p0", CHECKED[:half]), ("p1", CHECKED[half:]))], F.array(*relative).alias("families"))


def _coordinates_close() -> Column:
    """Whether no coordinate differs by more than ``DISTANCE``."""
    close = F.lit(True)
    for part in ("p0", "p1"):
        for i in range(len(CHECKED) // 2):
            x, y = (F.shiftrightunsigned(F.col(f"{s}.{part}"), 8 * i).bitwiseAND(F.lit(255)) for s in "xy")
            close = close & (F.abs(x - y) <= DISTANCE)
    return close


def links(fps: DataFrame) -> DataFrame:
    """Distinct (fp long) -> edges (a, b) of all at most two bits apart; a pair may come more than once."""
    # Keys are hashes of (choice, coordinates); a collision only adds a pair that is then discarded.
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.get("families", F.lit(b)) for b in choice]) for i, choice in enumerate(CHOICES)])
    rows = pivot_table(fps).select("fp", "p0", "p1", F.explode(keys).alias("key"))
    same = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE
    # Spark takes the exploded rows for a row a fingerprint and would broadcast millions of them.
    pairs = rows.alias("x").hint("merge").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _coordinates_close() & same)
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, fp long, component_id), a row for each row.

    component_id is the least doc_id reachable over links, the document's own
    included. Null texts count as empty and empty texts link like any other;
    a null doc_id keeps its row and its component takes the least other id (null
    if there is none). Repeated rows stay. An empty table gives an empty result.
    Further columns are ignored.
    """
    marked = materialise(with_fingerprints(docs), "fingerprints")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(fps.select("fp")))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialise(placed.join(firsts, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Keep of each group of near copies one row, all columns as they are.

    The texts' fingerprints are linked through the pivot tables, as for ``near_duplicates``,
    and linked texts are compared (``resemblance``: five-word shingles, a similarity of 0.8
    or more). Near copies beyond ``DISTANCE`` bits follow by an exact prefix filter among
    what is still apart, as no radius is sure to meet each of them. The row kept
    has the group's least doc_id (rows without one come last), then the least text hash;
    of rows equal in both the least by their other columns. Unrelated texts that share a
    doc_id are groups of their own. Equal rows are reduced where they are read, so that
    a text in very many rows is a row a task after that.
    """
    linked = lambda marks: links(marks.select(F.col("mark").alias("fp")))
    groups = materialise(near_copies(docs, lambda text: _signed(fingerprint(text)), linked), "near-copies")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    winners = groups.groupBy("root").agg(F.min(place).alias("w")).select("w.doc_id", "w.hash")
    repeats = groups.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    known = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.hash") == F.col(f"{y}.hash"))
    winners = winners.alias("w").join(repeats.alias("r"), known("w", "r"), "left").select("w.doc_id", "w.hash", F.col("r.n").isNotNull().alias("repeated"))
    winners = materialise(winners.toDF("__id", "__hash", "__repeated"), "winners")
    keyed = docs.withColumn("__key", F.xxhash64(text_or_empty()))
    kept = keyed.join(winners, (F.col("__key") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter("not __repeated").select(*columns)
    again = kept.filter("__repeated").groupBy("__id", "__hash").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return once.unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the near-duplicate class of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
