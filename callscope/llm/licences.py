"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Templates are notices (titles, headers, statements, identifiers) and full licence
texts (``licence_texts``), each a sparse vector of its words weighted by the corpus'
inverse document frequency; words in no template weigh as the rarest.

Texts are compared in windows, so that what stands beside a notice does not dilute it.
Comment marks go first. Windows are single lines, runs of up to four sentences of a
block (lines up to a blank one, so wrapped headers are whole), blocks, for short
full texts as many words from a block's start as the text has, and of a file named as
a licence file the whole text.

A cosine of ``LEAST`` needs one of a template's heaviest words: windows without any of
these are not compared (this loses nothing), and most texts have none.

Versions and families are told apart by more than the cosine: a template that names a
version counts only where the window has it; of templates of different licences within
``MARGIN`` the one wins that has the greater share of the words they do not have in
common; and an unversioned name counts only where no versioned one is found.

A file without a licence of its own takes that of the nearest directory above it that
holds a recognised licence file: distinct directories are spread to their ancestors
and equi-joined, and the longest match wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded, materialise, table, text_or_empty

LEAST, MARGIN = 0.55, 0.1
SENTENCES = 4
#: A window for a full text has at least this share of its words.
FILLED = 0.7
#: Full texts of up to so many words are also looked for inside other texts.
SHORT = 400
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: Full texts by licence, plain files; a parameter of ``templates``.
TEXTS = Path(__file__).with_name("licence_texts")

# What licences ask to be said of themselves.
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
NOTICES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache", "Licensed under the Apache License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL", "GNU General Public License"),
    ("GPL", "Licensed under the GPL."),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL", "Licensed under the LGPL."),
    ("AGPL", "GNU Affero General Public License"),
    ("AGPL", "Licensed under the AGPL."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "This program is free software; " + _GNU.format(name="General Public License", mark=";", version="2")),
    ("GPL-3.0", "This program is free software: " + _GNU.format(name="General Public License", mark=",", version="3")),
    ("LGPL-2.1", "This library is free software; " + _GNU.format(name="Lesser General Public License", mark=";", version="2.1")),
    ("LGPL-3.0", "This library is free software: " + _GNU.format(name="Lesser General Public License", mark=",", version="3")),
    ("AGPL-3.0", "This program is free software: " + _GNU.format(name="Affero General Public License", mark=",", version="3")),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: GNU names by short name and version; each gives statements of one form.
GNU = {"GPL": ("General", ("2.0", "3.0")), "LGPL": ("Lesser General", ("2.1", "3.0")), "AGPL": ("Affero General", ("3.0",))}
CREATIVE_COMMONS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}


def notices() -> list[tuple[str, str]]:
    """(licence, notice) of all licences known: the fixed ones and those made by rule."""
    out = list(NOTICES)
    for short, (name, versions) in GNU.items():
        for v in versions:
            out += [(f"{short}-{v}", t) for t in (f"This work is licensed under the GNU {name} Public License, version {v}.", f"Licensed under the GNU {name} Public License, version {v}.", f"Licensed under the {short} version {v}.", f"{short} v{v}")]
    for code, name in CREATIVE_COMMONS.items():
        out += [(f"CC-{code.upper()}", t) for t in (f"Licensed under CC {code}.", f"This work is licensed under a Creative Commons {name} License.")]
        for v, kind in CC_VERSIONS.items():
            out += [(f"CC-{code.upper()}-{v}", t) for t in (f"Licensed under CC {code} {v}.", f"CC {code} {v}", f"This work is licensed under a Creative Commons {name} {v} {kind} License.", f"Creative Commons {name} {v} {kind}")]
    for licence in sorted({k for k, _ in out} - _names({k for k, _ in out})):
        ends = ("-only", "-or-later", "+", "") if licence.split("-")[0] in GNU else ("",)
        out += [(licence, f"SPDX-License-Identifier: {licence}{end}") for end in ends]
    return out


def _names(licences: set[str]) -> set[str]:
    """The names that stand for more than one licence: another one adds a version or number to them."""
    return {a for a in licences if any(re.fullmatch(re.escape(a) + r"-\d.*", b) for b in licences)}


def full_texts(folder: Path = TEXTS) -> list[tuple[str, str]]:
    return [(p.stem, p.read_text("utf-8")) for p in sorted(folder.glob("*.txt"))]


_TOKEN = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")
_NUMBER = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)?")
_CC = re.compile(r"\bcc[ -]by((?:[ -](?:nc|nd|sa)\b)*)(?:[ -]v?(?=\d))?")
_ATTRIBUTION = re.compile(r"\battribution((?:[ -]+(?:non-?commercial|share ?-?alike|no ?-?deriv(?:ative)?s?(?: works)?))+)")
_MARKS = re.compile(r"^\s*(?:/\*+|\*+/|\*+|//+!?|#+!?|--+|;+|%+|\"\"\"|<!--|rem\s)?\s*|\s*(?:\*+/|-->|\"\"\")?\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+")


def _together(m: re.Match) -> str:
    kinds = [k for k in ("noncommercial", "sharealike", "noderiv") if k in re.sub("[ -]", "", m.group(1))]
    return "-".join(["attribution", *({"noderiv": "noderivatives"}.get(k, k) for k in kinds)])


def tokens(text: str) -> list[str]:
    """Words in lower case; version numbers in one form (``v2.0``, ``2.0`` and ``2`` alike), Creative Commons names whole."""
    text = text.lower().replace("licence", "license")
    if "cc" in text:
        text = _CC.sub(lambda m: "cc by" + m.group(1).replace(" ", "-") + " ", text)
    if "attribution" in text:
        text = _ATTRIBUTION.sub(_together, text)
    return [w if w[0].isalpha() and w[0] != "v" else _NUMBER.fullmatch(w).group(1) if _NUMBER.fullmatch(w) else w for w in _TOKEN.findall(text)]


class _Template:
    def __init__(self, licence: str, text: str, idf: dict[str, float]):
        self.licence, words = licence, tokens(text)
        self.size, self.words = len(words), frozenset(words)
        v = {w: c * idf[w] for w, c in Counter(words).items()}
        norm = sqrt(sum(x * x for x in v.values()))
        self.vector = {w: x / norm for w, x in v.items()}
        number = re.search(r"-(\d[\d.]*)$", licence)
        version = tokens(number.group(1))[0] if number else None
        self.version = version if version in self.words else None

    def cues(self, least: float) -> set[str]:
        """The heaviest words; a vector without any of them has a cosine below ``least``."""
        out, left = set(), 1.0
        for w, x in sorted(self.vector.items(), key=lambda p: (-p[1], p[0])):
            if left < least * least:
                break
            out.add(w)
            left -= x * x
        return out


class Matcher:
    """Templates as unit vectors under given document frequencies."""

    def __init__(self, short: list[tuple[str, str]], full: list[tuple[str, str]], n: int, df: dict[str, int], least: float = LEAST):
        self.rarest, self.least = log(1 + n) + 1, least
        words = {w for _, t in [*short, *full] for w in tokens(t)}
        self.idf = {w: log((1 + n) / (1 + df.get(w, 0))) + 1 for w in words}
        self.short = [_Template(k, t, self.idf) for k, t in short]
        self.full = [_Template(k, t, self.idf) for k, t in full]
        self.inside = [t for t in self.full if t.size <= SHORT]
        self.names = _names({t.licence for t in [*self.short, *self.full]})
        self.cues = frozenset().union(*(t.cues(least) for t in self.short)) if self.short else frozenset()
        self.by_word: dict[str, list[_Template]] = {}
        for t in self.short:
            for w in t.vector:
                self.by_word.setdefault(w, []).append(t)

    def cosines(self, words: list[str], templates: list[_Template] | None = None) -> list[tuple[float, _Template]]:
        """Every template (notices unless given) with a positive cosine to the words."""
        counts = Counter(words)
        weights = {w: c * self.idf.get(w, self.rarest) for w, c in counts.items()}
        norm = sqrt(sum(x * x for x in weights.values())) or 1.0
        dots: dict[int, float] = {}
        chosen: dict[int, _Template] = {}
        if templates is None:
            for w, x in weights.items():
                for t in self.by_word.get(w, ()):
                    chosen[id(t)] = t
                    dots[id(t)] = dots.get(id(t), 0.0) + x * t.vector[w]
            return [(d / norm, chosen[i]) for i, d in dots.items()]
        return [(sum(x * t.vector.get(w, 0.0) for w, x in weights.items()) / norm, t) for t in templates]

    def decide(self, found: list[tuple[float, _Template]], words: list[str]) -> tuple[float, str | None]:
        """The licence that a window's cosines speak for, None if they reach ``least`` for none."""
        has = set(words)
        left = [(s, t) for s, t in found if s >= self.least and (t.version is None or t.version in has)]
        if not left:
            return max((s for s, _ in found), default=0.0), None
        left.sort(key=lambda p: (-p[0], p[1].licence))
        score, best = left[0]
        for rival_score, rival in left[1:]:
            if rival.licence == best.licence or rival_score < score - MARGIN:
                continue
            own, other = best.words - rival.words, rival.words - best.words
            share = lambda d: len(d & has) / len(d) if d else 0.0
            if share(other) > share(own):
                score, best = rival_score, rival
        return score, best.licence

    def _windows(self, text: str) -> Iterator[tuple[list[str], list[_Template] | None]]:
        """Windows that have a cue, each with the templates it is compared with (None: all notices)."""
        lines = [_MARKS.sub("", line) for line in text.split("\n")]
        worded = [tokens(line) for line in lines]
        cued = lambda words: not self.cues.isdisjoint(words)
        seen = set()
        for line, words in zip(lines, worded):
            if words and line not in seen and cued(words):
                seen.add(line)
                yield words, None
        starts, at = [], 0
        while at < len(lines):
            if not lines[at].strip():
                at += 1
                continue
            end = at
            while end < len(lines) and lines[end].strip():
                end += 1
            block = [w for words in worded[at:end] for w in words]
            if cued(block):
                starts.append(at)
                sentences = [tokens(x) for x in _SENTENCE.split(" ".join(lines[at:end]))]
                for i, first in enumerate(sentences):
                    joined = list(first)
                    for more in range(SENTENCES):
                        if more:
                            if i + more >= len(sentences):
                                break
                            joined = joined + sentences[i + more]
                        if cued(joined) and (more or len(sentences) > 1):
                            yield joined, None
                if end - at > 1:
                    yield block, None
            at = end
        if starts and self.inside:
            most = max(t.size for t in self.inside)
            for at in starts:
                ahead: list[str] = []
                for words in worded[at:]:
                    ahead += words
                    if len(ahead) >= most:
                        break
                for t in self.inside:
                    if len(ahead) >= FILLED * t.size:
                        yield ahead[: t.size], [t]

    def best(self, text: str, whole: bool = False) -> tuple[float, str | None]:
        """The best score of any window and the licence found; versioned licences before bare names, then the greatest score, ties by name."""
        if not whole and self.cues.isdisjoint(tokens(text)):
            return 0.0, None
        found: list[tuple[float, str | None]] = []
        inside: list[tuple[float, _Template, list[str]]] = []
        for words, templates in self._windows(text):
            if templates is None:
                found.append(self.decide(self.cosines(words), words))
            else:
                inside += [(s, t, words) for s, t in self.cosines(words, templates)]
        # Short full texts have windows of their own lengths; the longest window of the best place decides between them.
        inside.sort(key=lambda p: (-p[0], p[1].licence))
        if inside and inside[0][0] >= self.least:
            longest = max((w for s, _, w in inside if s >= inside[0][0] - MARGIN), key=len)
            found.append(self.decide([(s, t) for s, t, _ in inside], longest))
        if whole:
            words = tokens(text)
            found.append(self.decide(self.cosines(words, self.full), words))
        named = [f for f in found if f[1]]
        if not named:
            return max((s for s, _ in found), default=0.0), None
        return min(named, key=lambda f: (f[1] in self.names, -f[0], f[1]))


def _document_frequency(words: frozenset):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch["text"]:
                held.update(words.intersection(tokens(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), n], pa.int64())], names=["word", "n"])

    return count


def _scorer(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.best(text.as_py(), whole) for text, whole in zip(batch["text"], batch["is_file"].to_pylist())]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch[n] for n in kept] + [pa.array([k for _, k in found], pa.string()), pa.array([s for s, _ in found], pa.float64())], names=[*kept, "own_licence", "own_score"])

    return run


def scan(files: DataFrame, short: list[tuple[str, str]] | None = None, full: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, path, text) -> doc_id, path, own_licence, own_score, licence, licence_dir.

    ``licence`` is the file's own or else inherited one; ``licence_dir`` is the
    directory it was inherited from. ``short`` and ``full`` are (licence, text)
    templates, by default all of this module's. A text without any cue scores 0. A
    null text is empty, a null path is a file at the top; a directory with several
    licence files takes the best score, ties by path, then licence; repeated rows give
    repeated rows; an empty table gives none; further columns are ignored.
    """
    short, full = notices() if short is None else short, full_texts() if full is None else full
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    rows = files.select("doc_id", path.alias("path"), path.rlike(LICENCE_FILE).alias("is_file"), text_or_empty().alias("text"))
    words = frozenset(w for _, t in [*short, *full] for w in tokens(t))
    # One row a template word and one for the number of texts: bounded by the templates.
    counted = rows.select("text").transform(bounded).mapInArrow(_document_frequency(words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"]: r["n"] for r in counted}
    n = df.pop(None, 0)
    scored = rows.transform(bounded).mapInArrow(_scorer(Matcher(short, full, n, df)), f"doc_id {dict(rows.dtypes)['doc_id']}, path string, is_file boolean, own_licence string, own_score double")
    scored = materialise(scored.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), "licences")
    holders = scored.filter("is_file and own_licence is not null").groupBy("dir").agg(F.min_by("own_licence", F.struct(-F.col("own_score"), "path", "own_licence")).alias("given"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    spread = scored.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("licence_dir"))
    nearest = spread.join(holders.withColumnRenamed("dir", "licence_dir"), "licence_dir").groupBy("dir").agg(F.max_by(F.struct("given", "licence_dir"), F.length("licence_dir")).alias("near"))
    nearest = materialise(nearest, "nearest-licence")
    out = scored.join(nearest, "dir", "left")
    inherited = F.col("own_licence").isNull()
    return out.select("doc_id", "path", "own_licence", "own_score", F.coalesce("own_licence", "near.given").alias("licence"), F.when(inherited, F.col("near.licence_dir")).alias("licence_dir"))


def document_path(doc_id: Column, source: Column) -> Column:
    """A repository-like place for each document: source / thousands / sixty-fours / file; the first of each directory is its licence file."""
    block, shelf = F.floor(doc_id / 4096).cast("string"), F.floor(doc_id / 64).cast("string")
    file = F.when(doc_id % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), doc_id.cast("string"), F.lit(".txt")))
    return F.when(doc_id % 4096 == 0, F.concat_ws("/", source, block, F.lit("LICENSE"))).otherwise(F.concat_ws("/", source, block, shelf, file))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the licence of every document, own or inherited."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", document_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))
