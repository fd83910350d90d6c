r"""Information-theoretic sanitisation of personal data.

Base spans are found by fixed patterns in every text. Each base value is a
protected entity. A term that stands within ``CONTEXT`` words of an entity may
reveal it: with N documents, df(t) of them holding term t, df(e) entity e and
df(t,e) holding t in e's context in c different contexts, the disclosure of e by t is

    PMI(t;e) / IC(e) = log(N df'(t,e) / (df(t) df(e))) / log(N / df(e)),
    df'(t,e) = df(t,e) c / (c + 1).

It is 1 where t never comes without e, less what the discount takes: one context is
weak evidence, and copies of one document are one context. An entity that stands in one
document has its rare neighbours rated like any other. A term that repeats a part of the
entity's own value (a name in an address) reveals it whatever the counts. Terms at
``REMOVE`` or more are removed, at ``GENERALISE`` or more generalised, where they stand
in that entity's contexts. All counts cover all documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bit_table, bounded, materialise, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
CONTEXT, GENERALISE, REMOVE = 8, 0.7, 0.9
#: Shorter parts of an entity's value are no names.
LEAST_PART = 3
TERMS_HELD = 400_000
FILTER_BITS = 1 << 22

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is all of its characters straight before the ``@``, after the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order of start, then kind; code points, end exclusive."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def term_of(word: str) -> str:
    return word.lower().strip(_STRIP)


def _plain(word: str) -> str:
    """Without accents, as addresses spell names."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The terms around each entity with their places; the context's hash tells repeated contexts."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    covered = [False] * len(words)
    ranges = []
    for a, _, b in spans:
        first, last = max(int(np.searchsorted(starts, a, "right")) - 1, 0), int(np.searchsorted(starts, b, "left"))
        ranges.append((first, last))
        covered[first:last] = [True] * (last - first)
    found: dict[int, dict] = {}
    for (a, kind, b), (first, last) in zip(spans, ranges):
        value = text[a:b].lower() if kind == 0 else re.sub("[^0-9.]", "", text[a:b])
        own = {p for p in re.split(r"[^a-z]+", value) if len(p) >= LEAST_PART}
        held = found.setdefault(_hash(f"{kind}:{value}"), {})
        for i in [*range(max(0, first - CONTEXT), first), *range(last, min(len(words), last + CONTEXT))]:
            term = "" if covered[i] else term_of(text[slice(*words[i])])
            if len(term) > 1:
                held[words[i]] = _hash(term), not own.isdisjoint(re.split(r"[^a-z]+", _plain(term)))
    out = []
    for entity, held in found.items():
        context = _hash(",".join(str(h) for _, (h, _) in sorted(held.items())))
        out += [{"entity": entity, "term": h, "context": context, "own": own, "start": a, "end": b} for (a, b), (h, own) in sorted(held.items())]
        out.append({"entity": entity, "term": None, "context": context, "own": False, "start": None, "end": None})
    return out


_PLACE = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("own", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
_PLACES = "array<struct<entity: long, term: long, context: long, own: boolean, start: long, end: long>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, places = [], []
        for text in batch["text"]:
            text = text.as_py()
            spans.append(base_spans(text))
            places.append(_contexts(text, spans[-1]) if spans[-1] else [])
        names = [joined(s) for s in spans]
        counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["hash"], *counts, pa.array([hashlib.sha256(n.encode()).hexdigest() for n in names]), pa.array(names), pa.array(places, pa.list_(_PLACE))],
            names=["doc_id", "hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "places"],
        )


def _term_counts(wanted: bytes):
    """Documents a term, of terms whose bit is set; partial counts of bounded number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little").view(bool)
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            hashes = np.array([_hash(t) for t in held], np.int64)
            counts = np.fromiter(held.values(), np.int64, len(held))
            keep = bits[hashes % FILTER_BITS] if len(held) else np.zeros(0, bool)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(counts[keep])], names=["term", "n"])

        for batch in batches:
            for text in batch["text"]:
                held.update({w.strip(_STRIP) for w in set(text.as_py().lower().split())})
                if len(held) > TERMS_HELD:
                    yield flush()
        if held:
            yield flush()

    return count


def disclosure(n: Column, term_df: Column, entity_df: Column, joint: Column, contexts: Column) -> Column:
    """The share of an entity's information that a term gives away; 0 for entities that stand in every document."""
    known = F.log2(n / entity_df)
    told = F.log2(n * joint * contexts / (contexts + 1) / (term_df * entity_df))
    return F.when(known > 0, told / known).otherwise(0.0)


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, kind): the terms that reveal an entity, and what is done with them."""
    n = float(found.count())
    seen = found.filter("size(places) > 0").select(F.explode(F.array_distinct(F.transform("places", lambda p: F.struct(p["entity"], p["term"], p["context"], p["own"])))).alias("p")).select("p.*").toDF("entity", "term", "context", "own")
    counted = materialise(seen.groupBy("entity", "term", "context").agg(F.count("*").alias("n"), F.max("own").alias("own")).groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("contexts"), F.max("own").alias("own")), "pairs")
    entities = counted.filter("term is null").select("entity", F.col("joint").alias("entity_df"))
    pairs = counted.filter("term is not null")
    # A bit per term hash, 512 KB whatever the corpus: it only spares counts that nobody asks for.
    wanted = bit_table(pairs, "term", FILTER_BITS)
    counts = docs.select(text_or_empty().alias("text")).transform(bounded).mapInArrow(_term_counts(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("term_df"))
    rows = pairs.join(entities, "entity").join(counts, "term")
    share = disclosure(F.lit(n), *[F.col(c).cast("double") for c in ("term_df", "entity_df", "joint", "contexts")])
    kind = F.when(F.col("own") | (share >= REMOVE), F.lit(5)).when(share >= GENERALISE, F.lit(4))
    return rows.select("entity", "term", kind.alias("kind")).filter("kind is not null")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, hash, base figures, base, spans; a row for each row.

    A null text is empty and has no span; a null doc_id is carried; repeated rows
    give repeated rows; an empty table gives none; further columns are ignored.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    out = f"doc_id {dict(rows.dtypes)['doc_id']}, hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, places {_PLACES}"
    found = materialise(rows.transform(bounded).mapInArrow(_find, out).withColumn("row", F.monotonically_increasing_id()), "personal-data")
    terms = materialise(disclosing_terms(docs, found), "disclosing-terms")
    places = found.filter("size(places) > 0").select("row", F.inline("places")).filter("term is not null")
    marked = places.join(terms, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))
    marked = marked.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    base = F.transform(F.split("base", ","), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]) - 1).cast("int").alias("kind"), F.split(s, ":")[2].cast("long").alias("end")))
    merged = F.array_sort(F.concat(base, F.col("extra")))
    text = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    return found.drop("places").join(marked, "row", "left").withColumn("spans", F.when(F.col("extra").isNull(), F.col("base")).otherwise(text)).drop("row", "extra")


def _replacement(kind: int, shown: str) -> str:
    if kind < 4:
        return f"[{KINDS[kind].upper()}]"
    if kind == 5:
        return ""
    return "[NUMBER]" if _DIGIT.search(shown) else "[NAME]" if shown[:1].isupper() else "[WORD]"


def rewrite(text: str, spans: str) -> str:
    """The text with its spans replaced; overlapping ones are one, named by the first."""
    out, done = [], 0
    for span in spans.split(",") if spans else []:
        kind, a, b = span.split(":")
        a, b = int(a), int(b)
        if a >= done:
            out += [text[done:a], _replacement(KINDS.index(kind), text[a:b])]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        texts = [t if not s else rewrite(t or "", s) for t, s in zip(batch["text"].to_pylist(), batch["__spans"].to_pylist())]
        arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(arrays[:-1], names=batch.schema.names[:-1])


def sanitise(docs: DataFrame) -> DataFrame:
    """All rows with their spans replaced in ``text`` and ``n_chars`` (if there) brought up to date."""
    spans = find(docs).filter("spans <> ''").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__hash": F.xxhash64(text_or_empty())})
    rows = keyed.join(spans, ["__id", "__hash"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    done = rows.transform(bounded).mapInArrow(_rewrite, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the spans of every document."""
    return find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
