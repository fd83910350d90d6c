"""Rule tables as data: one automaton over all terms in place of an expression a term.

A table's terms become an Aho-Corasick automaton that tasks run over each text once,
so neither the plan nor the passes grow with the table. A table whose terms have more
than ``SLICE`` characters is split by hash into as many automata as keep to that, each
with a pass of its own; the result is the same.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from callscope.operators import lexicon as L

#: Characters of the terms of one automaton (a state of some hundred bytes each at most).
SLICE = 200_000
#: Bytes of texts that a worker is given at once.
BATCH = 1 << 22


def _automaton(terms) -> ahocorasick.Automaton:
    """Each distinct term with the places it has in ``terms``; empty terms are left out."""
    places: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        if term:
            places.setdefault(term, []).append(i)
    found = ahocorasick.Automaton()
    for term, at in places.items():
        found.add_word(term, at)
    found.make_automaton()
    return found


def _contained(automaton, text: str | None) -> set[int]:
    return {i for _, at in automaton.iter(text) for i in at} if text and len(automaton) else set()


def contained_terms(terms, ids=None) -> "callable":
    """A function of a column: the places, ascending, of the terms that the text contains, or what ``ids`` has at them."""
    automaton, ids = _automaton(terms), np.arange(len(terms)) if ids is None else np.array(ids, dtype=np.int64)

    @pandas_udf("array<long>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ids[np.array(sorted(_contained(automaton, t)), dtype=np.int64)])

    return found


def with_terms(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Rows and (term_id, term) -> the rows with ``term_ids``, ascending, of the terms that the text contains (as substrings).

    A null text or term contains or matches nothing; an empty table finds nothing. Texts come to a
    worker ``BATCH`` bytes at a time, so that its memory does not hang on their lengths.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    chars = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    slices = -(-chars // SLICE) or 1
    parts = []
    for i in range(slices):
        own = terms.filter(F.col("term").isNotNull() & (F.pmod(F.xxhash64("term"), F.lit(slices)) == i)).select("term_id", "term").collect()
        parts.append(contained_terms([r["term"] for r in own], [r["term_id"] for r in own])(F.col(text)))
    return rows.withColumn("term_ids", F.array_sort(F.flatten(F.array(*parts))))


def axis_hits(norm: Column, profile: L.Profile) -> Column:
    """``scoring.axis_hits`` by one automaton: axes heaviest first, up to five hits each in table order."""
    axes = profile.ranked
    listed = [(i, t) for i, a in enumerate(axes) for t in a.terms]
    automaton = _automaton([t for _, t in listed])

    def judged(text: str | None) -> list[dict]:
        hits: dict[int, list[str]] = {}
        for place in sorted(_contained(automaton, text)):
            hits.setdefault(listed[place][0], []).append(listed[place][1])
        return [{"key": axes[i].key, "label": axes[i].label, "weight": axes[i].weight, "hits": found[:5], "themes": list(axes[i].themes)} for i, found in sorted(hits.items())]

    @pandas_udf("array<struct<key: string, label: string, weight: int, hits: array<string>, themes: array<string>>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(judged)

    return found(norm)


def theme_tags(words: Column, themes=L.THEMES) -> Column:
    """``scoring.theme_tags`` by one automaton: a theme's words are word prefixes, with up to two words between those of a term.

    The automaton finds first words; what begins a word there is matched with the rest of its term.
    """
    listed = [(i, *w.split(maxsplit=1)) for i, t in enumerate(themes) for w in t.words if w.strip()]
    keys = [t.key for t in themes]
    automaton = _automaton([x[1] for x in listed])
    rests = [re.compile("".join(r"(?:\s+\w+){0,2}\s+" + re.escape(w) for w in " ".join(x[2:]).split()), re.ASCII) for x in listed]

    def tags(text: str | None) -> list[str]:
        found: set[int] = set()
        if text and len(automaton):
            for end, at in automaton.iter(text):
                start = end - len(listed[at[0]][1])  # the character before the first word
                if start >= 0 and (text[start].isalnum() or text[start] == "_"):
                    continue
                found.update(listed[i][0] for i in at if listed[i][0] not in found and rests[i].match(text, end + 1))
        return [keys[i] for i in sorted(found)]

    @pandas_udf("array<string>")
    def tagged(texts: pd.Series) -> pd.Series:
        return texts.map(tags)

    return tagged(words)
