"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, the phrases' names into phrases of
phrases, and so on. At each level runs of a symbol become one; deterministic coin
tossing then gives each symbol the place of the lowest bit in which it differs
from its left neighbour, with that bit, again and again until few values are left;
phrases begin at local maxima of these. Where a phrase begins thus depends on a
few neighbours only, and its name (a hash of what it holds) on its content, so
equal substrings share all phrases but those at their edges, at any offset.

A fingerprint is a bottom-k sketch of the names of the second and third level
(phrases of about ten and thirty bytes). The likeness of two is the share of their
joint sketch that both hold: an estimate of the Jaccard likeness of the name sets,
exact for texts of up to ``SKETCH`` names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded, table, text_or_empty

SKETCH = 64
LEVELS = 3
FROM_LEVEL = 2
WINDOW_CHARS = 1 << 18
MAX_RANGES = 1 << 16

_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(256)], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(29)
    return x


def _tosses(symbols: int) -> np.ndarray:
    """Table of (left << 8 | own) -> 2 * lowest differing bit + own bit there; 0 for equal."""
    left, own = np.meshgrid(np.arange(symbols), np.arange(symbols), indexing="ij")
    differ = left ^ own
    bit = np.bitwise_count((differ & -differ) - 1)
    out = np.zeros((256, 256), np.uint8)
    out[:symbols, :symbols] = np.where(differ == 0, 0, 2 * bit + ((own >> bit) & 1))
    return out.reshape(-1)


_TOSS = _tosses(256)


def _tossed(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = labels.copy()
    out[1:] = _TOSS[(labels[:-1].astype(np.uint16) << np.uint16(8)) | labels[1:]]
    out[first] = labels[first] & 1
    return out


def _phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols and the places where texts begin -> the same of the phrases."""
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) < len(symbols):
        runs = np.diff(at, append=len(symbols)).astype(_U)
        symbols = symbols[at]
        first = np.searchsorted(at, first)
        names = _mix(symbols.astype(_U) + (runs - _U(1)) * _U(0xD6E8FEB86659FD93))
    else:
        names = _mix(symbols.astype(_U))
    if symbols.dtype == np.uint8:
        labels = _tossed(symbols, first)
    else:
        differ = symbols.copy()
        differ[1:] ^= symbols[:-1]
        bit = np.bitwise_count((differ & (~differ + _U(1))) - _U(1))
        labels = (2 * bit + ((symbols >> bit.astype(_U)) & _U(1)).astype(np.uint8)).astype(np.uint8)
        labels[first] = (symbols[first] & _U(1)).astype(np.uint8)
        labels = _tossed(labels, first)
    labels = _tossed(_tossed(labels, first), first)
    begins = np.zeros(len(labels), bool)
    begins[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    begins[first[1:] - 1] = False  # a text's last symbol never begins a phrase, whatever text follows
    begins[first] = True
    at = np.flatnonzero(begins)
    sizes = np.diff(at, append=len(labels))
    place = np.arange(len(labels)) - np.repeat(at, sizes)
    sums = np.add.reduceat(names * _POWERS[np.minimum(place, 255)], at)
    return _mix(sums + sizes.astype(_U)), np.searchsorted(at, first)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts as hex, eight digits a name, ascending; empty for the empty text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    full = [i for i, r in enumerate(raw) if r]
    out = [""] * len(texts)
    if not full:
        return out
    symbols = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum([0, *(len(raw[i]) for i in full[:-1])])
    kept = []
    for level in range(1, LEVELS + 1):
        symbols, first = _phrases(symbols, first)
        if level >= FROM_LEVEL:
            kept.append(((symbols >> _U(32)).astype(np.uint32), np.append(first, len(symbols)).tolist()))
    for n, i in enumerate(full):
        names = np.unique(np.concatenate([s[f[n] : f[n + 1]] for s, f in kept]))[:SKETCH]
        out[i] = names.astype(">u4").tobytes().hex()
    return out


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if x == y:
        return 1.0
    a, b = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (x, y))
    # Below SKETCH names a sketch is the whole set; beyond the larger least bound nothing is known.
    joint = sorted(a | b)[:SKETCH]
    return sum(n in a and n in b for n in joint) / len(joint)


def _windows(rows: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 2 * len(row[1])
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (doc_id, text, next text) from rows that come in descending order, each range led by its successor's head."""
    part = run = following = last = None
    for batch in batches:
        for at, own, doc_id, text in zip(batch["part"].to_pylist(), batch["own"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            if at != part:
                part, run, following, last = at, None, None, None
            if not own:
                following = text
                continue
            if run != (doc_id,):
                following = last if run else following
                run = (doc_id,)
            last = text
            yield doc_id, text, following


_SCHEMA = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _windows(_pairs(batches), WINDOW_CHARS):
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in held]
        distinct = list(dict.fromkeys([*(t for _, t, _ in held), *edited, *(n for _, _, n in held)]))
        of = dict(zip(distinct, fingerprints(distinct)))
        rows = [(d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), of[t], of[e], likeness(of[t], of[e]), likeness(of[t], of[n])) for (d, t, n), e in zip(held, edited)]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _SCHEMA)], names=[n for n, _ in _SCHEMA])


def with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt out by ranges of doc_id, each part with the head of what follows it.

    (part, own, doc_id, text): sorted inside its part by descending doc_id, rows
    with ``own`` false (the least text of the following id) before all others. Only
    each text itself moves, once. The ranges come from approximate quantiles and
    number at most twice ``MAX_RANGES``, which bounds all that is sent to the driver
    or broadcast. A doc_id that fills ranges of its own, and null ids, which come
    after all others, are dealt out over several parts by their texts' hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = min(4 * parts, MAX_RANGES)
    total, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    found, often = np.unique(np.array(rows.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)), float), return_counts=True)
    alone = {x: int(n) for x, n in zip(found, often) if n > 1 and x + 1 > x}
    bounds = np.array(sorted({*found, *(x + 1 for x in alone)}))
    # The range that begins with an id of its own holds that id only; the last range is that of null.
    shares = [1, *(alone.get(x, 1) for x in bounds), -(-(total - known) * ranges // max(total, 1)) or 1]
    offsets = np.cumsum([0, *shares[:-1]])
    shares = np.array(shares)

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        at = np.searchsorted(bounds, ids.to_numpy(float, na_value=np.nan), "right")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, at).astype("int32"))

    @F.pandas_udf("int")
    def part_of(ids, salts):
        import pandas as pd

        at = np.where(ids.isna(), len(bounds) + 1, np.searchsorted(bounds, ids.to_numpy(float, na_value=np.nan), "right"))
        return pd.Series((offsets[at] + salts.to_numpy() % shares[at]).astype("int32"))

    heads = sorted((r["range"], r["head"]) for r in rows.select("doc_id", range_of("doc_id").alias("range")).groupBy("range").agg(F.min("doc_id").alias("head")).collect())
    turns = [(heads[(i + 1) % len(heads)][1], int(offsets[r]), int(shares[r])) for i, (r, _) in enumerate(heads)]
    lead = F.broadcast(spark.createDataFrame(turns, "head long, at int, n int"))
    first = rows.join(lead, rows["doc_id"].eqNullSafe(lead["head"])).groupBy("at", "n", "doc_id").agg(F.min("text").alias("text"))
    first = first.select(F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("part"), F.lit(False).alias("own"), "doc_id", "text")
    salt = F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("int")
    own = rows.select(part_of("doc_id", salt).alias("part"), F.lit(True).alias("own"), "doc_id", "text")
    return own.unionByName(first).repartition(parts, "part").sortWithinPartitions("part", "own", F.col("doc_id").desc_nulls_first(), F.col("text").desc())


def compare_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document by doc_id; after the last comes the first.
    Of rows that share a doc_id the one with the least text is "the next document"
    to those before; all of them have the same next one. A null text is empty, a
    null doc_id comes last, an empty table gives no rows, further columns are
    ignored.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).transform(bounded).mapInArrow(_compare, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprints of every document, its edited text, and their likeness."""
    return compare_edits(table(spark, sf_dir, "documents"))
