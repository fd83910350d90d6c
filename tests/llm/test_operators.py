"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import bpe, chat, lcp, licences, mixing, pii, quality, rules, simhash, tokens, wordpieces

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, fp string, row int, kind string"
EDGES = [
    (1, None, None, None, None, "x", "y", 1, "z"),
    (2, "", "en", "a", 0, None, None, None, None),
    (2, "", "en", "a", 0, None, None, None, None),
    (3, "a b", "en", "a", 3, "x", "y", 1, "z"),
    (None, "null id, some words here", "en", None, 5, "x", "y", 1, "z"),
    (4, "word " * 30000 + "end", "en", "b", 150003, "x", "y", 1, "z"),
    (5, "<|endoftext|> \x1c　 é\n\n  tab\t", None, "b", 9, "x", "y", 1, "z"),
    (6, "same text again", "en", "b", 9, "x", "y", 1, "z"),
    (7, "same text again", "en", "b", 9, "x", "y", 1, "z"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return wordpieces.load(tokens.default_tokenizer())


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


# 1


GNU_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
HEADERS = [
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
    ("This program is free software; " + GNU_TERMS.format("General Public License", ";", "2"), "GPL-2.0"),
    ("This program is free software: " + GNU_TERMS.format("General Public License", ",", "3"), "GPL-3.0"),
    ("This library is free software; " + GNU_TERMS.format("Lesser General Public License", ";", "2.1"), "LGPL-2.1"),
    ("This program is free software: " + GNU_TERMS.format("Affero General Public License", ",", "3"), "AGPL-3.0"),
    ("GNU General Public License", "GPL"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under the GPL v2", "GPL-2.0"),
    ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("CC BY NC SA 4.0", "CC-BY-NC-SA-4.0"),
    ("CC BY-ND", "CC-BY-ND"),
    ("cc-by-sa-3.0", "CC-BY-SA-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("            Apache License\n      Version 2.0, January 2004\n   http://www.apache.org/licenses/", "Apache-2.0"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("SPDX-License-Identifier: GPL-3.0+", "GPL-3.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("Copyright (c) 2024 Some Person. All rights reserved. Licensed under the MIT License. See LICENSE in the project root for license information.", "MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD"),
    ("This file is subject to the terms of the Mozilla Public License, version 2.0.", "MPL-2.0"),
    ("a book about the general public and how to license a car", None),
    ("", None),
]


def test_licence_headers_wrapped_and_inside_texts():
    import textwrap

    m = licences.Matcher(licences.notices(), licences.full_texts(), 1000, {})
    prose = "lorem ipsum dolor sit amet consectetur. " * 30
    for text, want in HEADERS:
        shapes = [text, "\n".join("// " + x for x in text.split("\n")), "/*\n" + "\n".join(" * " + y for x in text.split("\n") for y in textwrap.wrap(x, 50) or [""]) + "\n */\nint main() {}\n"]
        if "\n" not in text and len(text.split()) > 5:
            shapes.append(prose + text.rstrip(".") + ". " + prose)
        for shape in shapes:
            assert m.best(shape)[1] == want, shape


def test_licence_texts():
    m = licences.Matcher(licences.notices(), licences.full_texts(), 1000, {})
    for licence, text in licences.full_texts():
        own = text.replace("<year>", "2019").replace("<owner>", "Ann Other").replace("<copyright holders>", "Ann Other")
        score, found = m.best(own, True)
        assert found == licence and score > 0.9
        if len(licences.tokens(text)) <= licences.SHORT:
            assert m.best("".join(f"// {line}\n" for line in own.split("\n")) + "\nint main() { return 0; }\n" * 50)[1] == licence


def test_cosines_and_cues_by_brute_force():
    r = random.Random(1)
    df = {w: r.randrange(1, 900) for _, t in licences.notices() for w in licences.tokens(t)}
    m = licences.Matcher(licences.notices(), [], 1000, df)
    idf = lambda w: np.log(1001 / (1 + df[w])) + 1 if w in df else np.log(1001) + 1
    vector = lambda words: {w: c * idf(w) for w, c in Counter(words).items()}
    pool = [*df, *"some other words of no template".split()]
    for _ in range(300):
        words = r.choices(pool, k=r.randint(1, 12)) if r.random() < 0.5 else licences.tokens(r.choice(licences.notices())[1])[: r.randint(1, 12)]
        got = {id(t): s for s, t in m.cosines(words)}
        v = vector(words)
        for (_, text), t in zip(licences.notices(), m.short):
            u = vector(licences.tokens(text))
            want = sum(v[w] * u.get(w, 0) for w in v) / np.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
            assert np.isclose(got.get(id(t), 0.0), want)
            assert want < licences.LEAST or not m.cues.isdisjoint(words)


def test_licences_are_inherited_from_the_nearest_directory_by_brute_force(spark, empty):
    r = random.Random(2)
    notice = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "Apache-2.0": "# Licensed under the Apache License, Version 2.0."}
    rows, own = [], {}
    for i in range(300):
        folder = "/".join(r.choice("ab") for _ in range(r.randint(0, 5)))
        name = r.choice(["LICENSE", "LICENSE.txt", "x.py", "y.py", "z.py", "z.py", "z.py"])
        licence = r.choice([*notice, None]) if name.startswith("LICENSE") or r.random() < 0.1 else None
        rows.append((i, "/".join(filter(None, [folder, name])), notice.get(licence, r.choice(["code", "", None])), "extra", 1.0))
        own[i] = licence
    rows += [(1000, None, "code", "x", 0.0), (None, "a/b/x.py", None, None, None), (1001, "a/q.py", "word " * 50_000, "x", 1.0), (1002, "a/q.py", "word " * 50_000, "x", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string, dir string, own_score double")
    got = licences.scan(frame).collect()
    assert len(got) == len(rows)
    scores = {x.doc_id: x.own_score for x in got}
    held: dict = {}
    for i, path, *_ in rows[:300]:
        folder, _, name = path.rpartition("/")
        if name.startswith("LICENSE") and own[i]:
            held.setdefault(folder, []).append((-scores[i], path, own[i]))
    for x in got:
        folder = (x.path or "").rpartition("/")[0]
        want, where = own.get(x.doc_id), None
        steps = folder.split("/") if folder else []
        for n in range(len(steps), -1, -1):
            if want is None and "/".join(steps[:n]) in held:
                where = "/".join(steps[:n])
                want = min(held[where])[2]
        assert (x.own_licence, x.licence, x.licence_dir) == (own.get(x.doc_id), want, where)
    assert licences.scan(frame.limit(0)).count() == 0


# 2


def parsed_by_loop(text):
    """The fingerprint's names of one text, a symbol at a time."""
    word = (1 << 64) - 1

    def mix(x):
        x = x * 0xBF58476D1CE4E5B9 & word
        x ^= x >> 32
        x = x * 0x94D049BB133111EB & word
        return x ^ x >> 29

    def tossed(labels):
        out = [labels[0] & 1]
        for left, own in zip(labels, labels[1:]):
            bit = ((left ^ own) & -(left ^ own)).bit_length() - 1
            out.append(2 * bit + (own >> bit & 1) if left != own else 0)
        return out

    symbols, kept = list(text.encode()), []
    for level in (1, 2, 3):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mix(x + (n - 1) * 0xD6E8FEB86659FD93 & word) for x, n in runs]
        labels = [x for x, _ in runs]
        for _ in range(3 if level == 1 else 4):
            labels = tossed(labels)
        begins = [i for i in range(len(labels)) if i == 0 or i < len(labels) - 1 and labels[i - 1] < labels[i] > labels[i + 1]]
        symbols = []
        for a, b in zip(begins, [*begins[1:], len(labels)]):
            total = sum(n * pow(0x9E3779B97F4A7C15, min(i, 255), 1 << 64) for i, n in enumerate(names[a:b]))
            symbols.append(mix(total + b - a & word))
        if level > 1:
            kept += [x >> 32 for x in symbols]
    return "".join(f"{x:08x}" for x in sorted(set(kept))[: lcp.SKETCH])


def test_fingerprints_by_brute_force():
    r = random.Random(2)
    texts = ["a", "ab", "aaaa", "é" * 300, "<b>ö</b>" * 40, *("".join(r.choices("abc é\n", k=r.randint(1, 400))) for _ in range(60))]
    assert lcp.fingerprints(texts) == [parsed_by_loop(t) for t in texts] == [lcp.fingerprints([t])[0] for t in texts]
    for x, y in zip(texts, texts[1:]):
        a, b = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in map(parsed_by_loop, (x, y)))
        joint = sorted(a | b)[: lcp.SKETCH]
        assert lcp.likeness(*lcp.fingerprints([x, y])) == sum(n in a and n in b for n in joint) / len(joint)


def test_fingerprints_of_edits(spark, docs, edges, empty):
    repeated = [(r.doc_id % 7, r.text) if r.doc_id % 3 else (None if r.doc_id % 2 else 3, r.text) for r in docs.select("doc_id", "text").collect()]
    for frame in (docs, edges, spark.createDataFrame(repeated, "doc_id long, text string"), spark.createDataFrame([(5, "one"), (5, "text"), (5, None)], "doc_id long, text string"), spark.createDataFrame([(None, "one"), (None, "other")], "doc_id long, text string")):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        groups = [k for i, k in enumerate(rows) if i == 0 or rows[i - 1][0] != k[0]]
        following = {k[0]: groups[(i + 1) % len(groups)][1] for i, k in enumerate(groups)}
        want = Counter()
        for doc_id, text in rows:
            half = len(text) // 2
            edited = text[: len(text) - half] + following[doc_id][:half]
            of = lcp.fingerprints([text, edited, following[doc_id]])
            want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), of[0], of[1], lcp.likeness(of[0], of[1]), lcp.likeness(of[0], of[2])] += 1
        got = lcp.compare_edits(frame).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want
    assert lcp.compare_edits(empty).count() == 0


def test_hot_ids_are_dealt_out(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}") for i in range(3000)]
    found = lcp.with_next(spark.createDataFrame(rows, "doc_id long, text string")).filter("own").groupBy("part").count().collect()
    assert max(r["count"] for r in found) < 600


def test_equal_substrings_share_signatures():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 9)))
    body = " ".join(word() for _ in range(400))
    a, b, c = lcp.fingerprints([body, "offset: " + body, " ".join(word() for _ in range(400))])
    assert lcp.likeness(a, b) > 0.85 and lcp.likeness(a, c) < 0.05 and lcp.likeness(a, a) == 1.0
    assert lcp.fingerprints(["", body]) == ["", a]


# 3


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    sizes = np.array([4, 1, 3])
    potential, links = r.normal(size=8), r.normal(size=(2, 2))
    got, _ = quality.marginals(potential, sizes, links)
    at = 0
    for n in sizes:
        weight = np.zeros((2**n,))
        labels = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        for k, y in enumerate(labels):
            weight[k] = np.exp(sum(potential[at + i] * y[i] for i in range(n)) + sum(links[y[i - 1], y[i]] for i in range(1, n)))
        assert np.allclose(got[at : at + n], (weight[:, None] * labels).sum(axis=0) / weight.sum())
        at += n


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good >= 0.7).mean() > 0.97 and (bad >= 0.7).mean() < 0.1


def scored_by_enumeration(field, text):
    """Length-weighted marginals of a short text by all its labellings."""
    lines = text.split("\n")
    own, lengths = quality.line_figures(text)
    own = np.array(own)
    zero = np.zeros(quality.FIGURES)
    potential = [float(np.concatenate([own[i], own[i - 1] if i else zero, own[i + 1] if i + 1 < len(own) else zero, [1.0]]) @ field.weights) for i in range(len(own))]
    mass, good = 0.0, np.zeros(len(lines))
    for k in range(2 ** len(lines)):
        y = [k >> i & 1 for i in range(len(lines))]
        w = np.exp(sum(p * a for p, a in zip(potential, y)) + sum(field.links[a, b] for a, b in zip(y, y[1:])))
        mass += w
        good += w * np.array(y)
    q = float((good / mass) @ np.array(lengths) / sum(lengths))
    return 1 / (1 + np.exp(-(field.scale[0] * q + field.scale[1])))


def test_scores_by_brute_force(spark, docs):
    r = np.random.default_rng(3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(docs, labels)
    random_field = quality.Field(r.normal(size=3 * quality.FIGURES + 1), r.normal(size=(2, 2)), (2.0, -1.0))
    texts = [t for t in (x.text or "" for x in docs.select("text").collect()) if t.count("\n") < 10][:80] + ["", "\n", "one line", "same\nsame\nsame"]
    for f in (field, random_field):
        assert np.allclose(f.score(texts), [scored_by_enumeration(f, t) for t in texts])
    got = {x.text: x["__score"] for x in quality.with_scores(spark.createDataFrame([(t,) for t in texts], "text string"), field).collect()}
    assert all(np.isclose(got[t], scored_by_enumeration(field, t)) for t in texts)


def test_fit_keeps_its_bounds(spark):
    rows = [(i, "good words of a line, and more. \n" * (1 + i % 5) if i % 2 else "### $$$ \n" * (1 + i % 5)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    quality_fit = quality.fit
    quality.fit = lambda rows: seen.append(rows) or quality_fit(rows)
    try:
        quality.train(frame, labels, sample=100, chain=4, lines=90)
    finally:
        quality.fit = quality_fit
    for k in (0, 1):
        sizes = [len(n) for label, _, n in seen[0] if label == k]
        assert 0 < sum(sizes) <= 90 and max(sizes) <= 4


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(edges, labels).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(edges, labels, 0.4).columns == edges.columns


# 4


def test_shards_round_trip():
    r = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 70_000):
        x = np.minimum(r.zipf(1.2, n), 50_256).astype("<u4")
        lengths = np.array([n // 2, 0, n - n // 2])
        out_ids, out_lengths, out = tokens.unpack(tokens.pack([5, None, -7], lengths, x))
        assert out_ids == [5, None, -7] and (out_lengths == lengths).all() and (out == x).all()
    wide = np.arange(70_000, dtype="<u4")
    assert (tokens.unpack(tokens.pack([1], np.array([70_000]), wide))[2] == wide).all()


def test_token_files(spark, docs, edges, empty, library, tmp_path):
    for n, frame in enumerate((docs, edges, empty)):
        folder = f"file://{tmp_path}/{n}"
        (tmp_path / str(n)).mkdir()
        manifest = tokens.write_shards(frame, folder, tokens.default_tokenizer(), 5000)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_digests(folder, manifest).collect())
        rows = {(r.doc_id, ids(library, r.text) + bytes(4)) for r in frame.select("doc_id", "text").collect()}
        assert [g[0] for g in got] == [sum(g[2] for g in got[:i]) for i in range(len(got))]
        assert {(d, n, c) for _, d, n, c in got} == {(d, len(x) // 4, zlib.crc32(x)) for d, x in rows} and len(got) == frame.count()
        keys = [(d is None, d or 0) for _, d, _, _ in got]
        assert keys == sorted(keys)


# 5


def test_mix_meets_targets_by_brute_force(spark, docs, edges, empty):
    for frame in (docs, edges):
        rows = mixing.mix(frame).toPandas()
        sizes = Counter()
        for r in frame.select("source", "text").collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
        target, capped = {}, set()
        while True:
            left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
            free = [s for s in order if s not in capped]
            target = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
            over = {s for s in free if target[s] > 2 * sizes[s]}
            if not over:
                break
            capped |= over
        for r in rows.itertuples():
            assert r.target == pytest.approx(target[r.source if isinstance(r.source, str) else None]) and 0 <= r.copies <= 2
        for s in order:
            own = rows[rows.source.isna() if s is None else rows.source == s]
            assert abs((own["size"] * own.copies).sum() - target[s]) <= own["size"].max() / 2 + 1e-6 or own.doc_id.duplicated().any() or own.doc_id.isna().any()
        want = Counter()
        for r in rows.itertuples():
            want[None if r.doc_id != r.doc_id else int(r.doc_id), r.source if isinstance(r.source, str) else None] += r.copies
        assert Counter((r.doc_id, r.source) for r in mixing.mixed_rows(frame).collect()) == +want
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert mixing.mixed_rows(edges).columns == edges.columns


# 6


_KINDS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: all(int(p) <= 255 for p in g.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda g, d: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 10 <= len(d) <= 15),
]


def test_base_spans_by_brute_force():
    r = random.Random(6)
    alphabet = [*"a@@..-+1234 ()5é%_\n", "1.2.3.4", "4111 1111 1111 1111", "a@b.c", "+1 (555) 123-4567"]
    for _ in range(20_000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 24)))
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(_KINDS) for m in re.finditer(p, text) if ok(m.group(), re.sub("[^0-9]", "", m.group())))
        assert pii.base_spans(text) == want, text
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "a" * 100_000) == []


def disclosed_by_loop(texts):
    """Spans of every text by a plain count over all texts."""
    from math import log2

    def term(w):
        return w.lower().strip(pii._STRIP)

    marks, df = [], Counter()
    for text in texts:
        df.update({term(w) for w in text.split()})
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        spans = pii.base_spans(text)
        covered = [any(a < y and x < b for a, _, b in spans) for x, y in words]
        held: dict = {}
        for a, kind, b in spans:
            value = text[a:b].lower() if kind == 0 else re.sub("[^0-9.]", "", text[a:b])
            before = [i for i, (x, y) in enumerate(words) if y <= a][-pii.CONTEXT :]
            after = [i for i, (x, y) in enumerate(words) if x >= b][: pii.CONTEXT]
            near = held.setdefault((kind, value), {})
            near |= {words[i]: term(text[slice(*words[i])]) for i in [*before, *after] if not covered[i] and len(term(text[slice(*words[i])])) > 1}
        marks.append((spans, held))
    joint, contexts, entity_df = Counter(), {}, Counter()
    for _, held in marks:
        for entity, near in held.items():
            entity_df[entity] += 1
            context = tuple(t for _, t in sorted(near.items()))
            for t in set(near.values()):
                joint[entity, t] += 1
                contexts.setdefault((entity, t), set()).add(context)
    out = []
    for spans, held in marks:
        extra: dict = {}
        for entity, near in held.items():
            for place, t in near.items():
                c = len(contexts[entity, t])
                known = log2(len(texts) / entity_df[entity])
                share = log2(len(texts) * joint[entity, t] * c / (c + 1) / (df[t] * entity_df[entity])) / known if known > 0 else 0.0
                own = {p for p in re.split("[^a-z]+", entity[1]) if len(p) >= 3} & set(re.split("[^a-z]+", pii._plain(t)))
                kind = 5 if own or share >= pii.REMOVE else 4 if share >= pii.GENERALISE else 0
                if kind:
                    extra[place] = max(extra.get(place, 0), kind)
        out.append(pii.joined(sorted([*spans, *((a, k, b) for (a, b), k in extra.items())])))
    return out


def test_disclosing_terms_by_brute_force(spark, edges, empty):
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(300)] + ["Sóuza,", "(lab)"]
    filler = lambda: " ".join(r.choice(words[:60]) if r.random() < 0.8 else r.choice(words) for _ in range(r.randint(0, 30)))
    values = ["ana.souza@lab.org", "zy@labs.org", "10.0.0.7", "+1 (555) 123-4567", "4111 1111 1111 1111"]
    texts = [filler() for _ in range(300)]
    texts += [f"{filler()} ask Zyxwor Labs at {r.choice(values)} or Souza {filler()}" for _ in range(60)]
    texts += [f"{filler()} {v} {v} {r.choice(values)}" for v in values] + [f"lonely{i} word x{i}@single.example odd{i} {filler()}" for i in range(20)]
    texts += [texts[310]] * 40 + ["", "only@one.example"]  # copies are one context
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hash string, term int")
    got = {x.doc_id: x.spans for x in pii.find(frame).collect()}
    want = disclosed_by_loop(texts)
    assert [got[i] for i in range(len(texts))] == want
    kinds = Counter(k for w in want for k in re.findall("[a-z]+", w))
    assert kinds["removed"] > 20 and kinds["generalised"] > 20
    out = {x.doc_id: x.text for x in pii.sanitise(frame).collect()}
    assert not any(v in out[i] for i in range(300, 360) for v in values) and not any("Souza" in out[i] for i in range(300, 360) if "ana.souza" in texts[i])
    assert [out[i] for i in range(300)] == texts[:300]
    assert pii.find(edges).count() == len(EDGES) and pii.find(empty).count() == 0
    assert pii.sanitise(edges).columns == edges.columns and pii.sanitise(edges).count() == len(EDGES)


def test_disclosure_at_the_thresholds(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(1024.0, 1.0, 1.0, 1.0, 1.0), (1024.0, 4.0, 1.0, 1.0, 1.0), (4.0, 1.0, 4.0, 1.0, 1.0)], "n double, t double, e double, j double, c double")
    assert [x.s for x in row.select(pii.disclosure(*map(F.col, "ntejc")).alias("s")).collect()] == [0.9, 0.7, 0.0]
    assert 0.9 >= pii.REMOVE and 0.7 >= pii.GENERALISE


# 7


def test_codec_equals_library(spark, docs, edges, empty, library):
    r = random.Random(70)
    passage = " ".join(f"passage{r.randrange(500)}, {r.choice(['und', 'the', 'é!'])}" for _ in range(400))
    planted = [(i, f"head {i} " + passage[r.randrange(40) :] + f" tail {i}", "x") for i in range(40)] + [(100 + i, passage, "x") for i in range(5)] + [(200, passage[:700] + "日本語" * 900 + passage[700:], "x")]
    for frame in (docs, edges, spark.createDataFrame(planted, "doc_id long, text string, hash string")):
        want = Counter((r.doc_id, hashlib.sha256(ids(library, r.text)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in frame.select("doc_id", "text").collect())
        rows = bpe.encode_documents(frame, tokens.default_tokenizer()).collect()
        assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in rows) == want
        assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in rows)
    assert bpe.encode_documents(empty, tokens.default_tokenizer()).count() == 0


def test_shared_chunks_are_cut_alike_and_found():
    r = random.Random(71)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(3000))
    sets = [{k for _, k in bpe.chunks(head + passage) if k} for head in ("", "some other beginning ")]
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2
    bits = bytearray(bpe.FILTER_BITS // 8)
    for k in sets[0] & sets[1]:
        at = bpe._number(k) % bpe.FILTER_BITS
        bits[at >> 3] |= 1 << (at & 7)
    parts = bpe._Shared(bytes(bits)).parts("a third beginning " + passage)
    assert "".join(p for p, _ in parts) == "a third beginning " + passage and sum(k is not None for _, k in parts) >= len(sets[0]) - 2


def test_codec_fuzz(library):
    r = random.Random(7)
    alphabet = [" ", "\n", "\t", "a", "b", "1", "!", "'", "'s", "é", "\xa0", "　", "<|endoftext|>", "\x1c", "\0", "日", "  ", " the", "\nab.", " word and more"]
    coder = bpe.codec(tokens.default_tokenizer())
    joins = 0
    for text in [*("".join(r.choices(alphabet, k=r.randint(0, 300))) for _ in range(1500)), "a" * 50_000, "日本語" * 3000]:
        want = ids(library, text)
        assert coder.encode(text) == want and coder.decode(want).decode() == text
        at = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, r.randint(0, 6))))
        parts = [coder.encode(text[a:b]) if r.random() < 0.7 else text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        assert coder.assemble(parts) == want
        joins += sum(isinstance(p, bytes) for p in parts)
    assert joins > 2000


def test_repair_reaches_outward_until_ids_agree(library, monkeypatch):
    coder = bpe.codec(tokens.default_tokenizer())
    text = "one two three four five six seven eight nine ten"
    left, right = (np.frombuffer(ids(library, t), "<u4").copy() for t in (text[:23], text[23:]))
    place = coder._words(left)
    spelt = np.concatenate([np.frombuffer(ids(library, c), "<u4") for c in coder._text(left[place[-2] : place[-1]])])
    wrong = np.concatenate([left[: place[-2]], spelt, left[place[-1] :]])  # the last whole word is the same text in other ids
    assert coder._text(wrong) == coder._text(left)
    a, found, b = coder.join((wrong, coder._words(wrong)), "", (right, coder._words(right)))
    assert a == place[-3] and np.concatenate([wrong[:a], found, right[b:]]).tobytes() == ids(library, text)
    monkeypatch.setattr(coder, "_words", lambda x: np.arange(1, len(x)))  # places that no rule vouches for: what never agrees is encoded whole
    assert coder.assemble([left.tobytes(), right.tobytes()]) == ids(library, text)


# 8


def test_near_duplicates_by_brute_force(spark, docs, edges, empty):
    planted = docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "concat(text, ' tail') as text"))
    for frame in (planted, edges):
        rows = simhash.near_duplicates(frame).collect()
        texts = {(r.doc_id, simhash._signed(simhash.fingerprint(r.text))) for r in frame.select("doc_id", "text").collect()}
        assert {(r.doc_id, r.fp) for r in rows} == texts and len(rows) == frame.count()
        fps = np.array([r.fp for r in rows], np.int64).view(np.uint64)
        own = np.array([np.inf if r.doc_id is None else r.doc_id for r in rows])
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        while (least := np.array([own[n].min() for n in near])).tolist() != own.tolist():
            own = least
        assert [np.inf if r.component_id is None else r.component_id for r in rows] == own.tolist()
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, None}


def test_dense_groups_lose_no_link(spark):
    from callscope.llm.components import connected_components

    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {simhash._signed(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for b in base for _ in range(30)}
    fps |= {simhash._signed(base[0] ^ x ^ y << 60) for x in range(256) for y in range(8)}  # a group of thousands in few bands
    fps = sorted(fps)
    array = np.array(fps, np.int64)
    near = np.bitwise_count(array.view(np.uint64)[:, None] ^ array.view(np.uint64)[None, :]) <= 2
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).distinct().collect()
    place = {f: i for i, f in enumerate(fps)}
    assert {(place[e.a], place[e.b]) for e in edges} == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    roots = {x.node: x.root for x in connected_components(spark.createDataFrame(edges)).collect()}
    own = array.copy()
    while (least := np.array([own[n].min() for n in near])).tolist() != own.tolist():
        own = least
    assert [roots.get(f, f) for f in fps] == own.tolist()


def test_relative_coordinates_tell_bands_apart():
    values = np.random.default_rng(3).integers(0, 1 << 56, 4).tolist()
    for band, (first, *rest) in enumerate(simhash.PIVOTS):
        low = (1 << 8 * band) - 1
        for value in values:
            # The other bits do not matter; each value of the band has coordinates of its own.
            within = [(value & low) | x << 8 * band | (value & ~low) << 8 for x in range(256)]
            seen = [tuple((w ^ p).bit_count() - (w ^ first).bit_count() for p in rest) for w in within]
            assert len(set(seen)) == 256


def test_pivot_coordinates_are_distances(spark):
    r = random.Random(9)
    fps = [simhash._signed(r.getrandbits(64)) for _ in range(50)]
    of = {x.fp: x for x in simhash.pivot_table(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    unsigned = lambda f: f % (1 << 64)
    for f in fps:
        got = [(of[f][c] >> 8 * i) & 255 for c in ("p0", "p1") for i in range(8)]
        assert got == [(unsigned(f) ^ p).bit_count() for p in simhash.CHECKED]
        for family, packed in zip(simhash.PIVOTS, of[f].families):
            assert [((packed >> 8 * i) & 255) - 64 for i in range(len(family) - 1)] == [(unsigned(f) ^ p).bit_count() - (unsigned(f) ^ family[0]).bit_count() for p in family[1:]]


def test_kept_copies(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, long, "a"), (3, long, "b"), (3, "an unrelated text of other words altogether, quite another", "c"), (None, long, "d"), (None, "a text without an id and without a copy at all here", "e"), (None, "a text without an id and without a copy at all here", "f"), (5, long, "g"), (5, long, "g"), (9, None, "h"), (8, " ", "i")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    assert sorted(r.hash for r in simhash.keep_one(frame).collect()) == ["b", "c", "e", "i"]


# 9


def test_parts_are_flattened(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <|image|> \\l"), part("image", None, "i.png", 56, 30), part("audio", None, "a.wav", s=2.0)]), (1, 1, "assistant", [part("text", "x<"), part("text", "y")]), (1, None, None, [part("document", None, "d.pdf", p=2)]), (None, 0, "user", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    done = chat.format_conversations(frame)
    (one,) = [r for r in done.collect() if r.conv_id == 1]
    assert [(a.ordinal, a.kind, a.uri, a.tokens) for a in one.attachments] == [(1, "document", "d.pdf", 512), (2, "image", "i.png", 4), (3, "audio", "a.wav", 50)]
    assert one.expanded_tokens == 566 and one.formatted.count("<|image|>") == 1
    (back,) = [r for r in chat.read_back(done).collect() if r.conv_id == 1]
    assert back.loss == ["x<", "y"] and back.turns[1].text.startswith("see <|image|> \\l") and back.turns[2].text == "x<y"
    assert chat.format_conversations(frame.limit(0)).count() == 0


# 10


def test_rules_by_brute_force(spark, docs, edges, empty):
    for frame in (docs, edges):
        got = rules.assess(frame).toPandas()
        texts = [r.text or "" for r in frame.select("text").collect()]
        want = []
        for text in texts:
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want.append((len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)))
        assert sorted(map(tuple, got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False))) == sorted(want)
        assert not (got.base_failed & got.kept).any()
    assert rules.assess(empty).count() == 0


# all


@pytest.mark.parametrize("name", ["op5_source_mixing", "op9_chat_formatting", "op10_quality_rules"])
def test_matches_oracle(spark, name):
    import oracle

    from callscope.llm import catalog

    assert oracle.difference(spark, name, SF, catalog.QUERIES, catalog.ORACLE_SQL) == ""


def test_stage_keeps_one_of_near_copies_by_brute_force(spark, docs, monkeypatch):
    import corpus_pipeline
    from callscope.llm import resemblance

    r = random.Random(5)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice((3, 30, 120, 400)))] for _ in range(40)]
    texts = [t for t in (" ".join(w) for w in base)]
    for words in base:
        for share in (0.004, 0.01, 0.02, 0.04, 0.06):
            copy = [f"x{r.randrange(9)}" if r.random() < share else w for w in words]
            texts.append(" ".join(copy[r.randrange(3) :]))
    texts += ["one common line of many words that stands in very many texts " * 2 + " ".join(f"u{r.randrange(10**6)}" for _ in range(10)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]

    def shingles(text):
        words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", (text or "").encode().lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                own[max(root(i), root(j))] = min(root(i), root(j))
                far += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > simhash.DISTANCE
    assert far > 20
    want = {rows[i][0] for i in range(len(rows)) if own[i] == i}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (4, 10**9):
        monkeypatch.setattr(resemblance, "COMMON", common)
        assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, frame, SF).collect()} == want


def test_stage_links_by_fingerprints_and_meets_a_pair_once(spark, monkeypatch):
    from callscope.llm import resemblance

    r = random.Random(6)
    base = [f"w{i}" for i in range(1500)]
    # Any two texts share most of their shingles and are not similar enough.
    texts = [" ".join(w if i not in own else f"x{r.randrange(10**6)}" for i, w in enumerate(base)) for own in [set(r.sample(range(1500), 22)) for _ in range(25)]]
    long = [f"v{i}" for i in range(2000)]
    texts += [" ".join(long), " ".join([*long[:-1], "end"])]
    assert (simhash.fingerprint(texts[-1]) ^ simhash.fingerprint(texts[-2])).bit_count() <= simhash.DISTANCE
    met, inner = [], resemblance._verified

    def verified(pairs, nodes, docs):
        found = inner(pairs, nodes, docs)
        met.append((pairs.count(), pairs.distinct().count(), found.count()))
        return found

    monkeypatch.setattr(resemblance, "_verified", verified)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == len(texts) - 1
    first, last = met[0], met[-1]
    assert first[2] == 1 and last[1] > 150 and last[0] <= 1.5 * last[1]


def test_chat_edges(spark, empty):
    from pyspark.sql import functions as F

    rows = [(1, 1, "user", "b", "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"), (1, None, None, None, "x"), (2, 0, "assistant", "word < \\l " * 40_000, "y"), (None, 0, "user", "no id", "z"), (3, 0, "assistant", "", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    clash = frame.withColumns({"formatted": F.lit("f"), "m": F.lit(1), "mask": F.lit("k"), "shown": F.lit(2)})
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(clash)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("user", "b")] and back[1].loss == ["a", "a"]
    assert back[2].turns[0].text == rows[4][3] and back[2].loss == [rows[4][3]] and back[3].loss == [""] and back[None].loss == []
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    """All other operators over rows that repeat, tie and carry columns named like their own."""
    from pyspark.sql import functions as F

    texts = ["Released under the MIT License.", "a@b.org is Bob, B. at 10.0.0.1", "same words again and again and again, so it goes on", "", None]
    rows = [(i % 4, t, "s") for i in range(3) for t in texts for _ in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = frame.withColumns({c: F.lit("x") for c in ("hash", "row", "key", "place", "own", "part", "h", "size", "copies", "score", "n_words", "lines", "words", "root", "node", "fp", "path", "dir", "ids", "name", "content", "label", "figures", "spans", "base", "places")})
    assert pii.find(clash).count() == pii.sanitise(clash).count() == mixing.mix(clash).count() == rules.assess(clash).count() == len(rows)
    assert simhash.near_duplicates(clash).count() == lcp.compare_edits(clash).count() == bpe.encode_documents(clash, tokens.default_tokenizer()).count() == len(rows)
    assert licences.scan(clash.withColumn("path", F.lit("a/x"))).count() == len(rows)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.classify(clash, labels).count() == len(rows)
    assert pii.sanitise(clash).columns == simhash.keep_one(clash).columns == mixing.mixed_rows(clash).columns == quality.keep_good(clash, labels).columns == clash.columns
    assert simhash.keep_one(clash).count() == 4


def test_pipeline_stages_by_brute_force(spark, library):
    """Each stage over what its predecessor kept: kept ids, texts and copies worked out by loops."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # 1: the fitted field by enumeration for short texts, by the field's own sums for the others
    field = quality.train(docs, labels)
    scores = {}
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        scores[r.doc_id] = scored_by_enumeration(field, text) if text.count("\n") < 9 else float(field.score([text])[0])
    good = stages["quality_classifier"](spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= quality.THRESHOLD}
    # 2: five-word shingles, similarity of 0.8 or more, the least id of each group
    rows = sorted((r.doc_id, r.text or "") for r in good.select("doc_id", "text").collect())
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", text.encode().lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((own[i], own[j]))
                own = [low if x == high else x for x in own]
    single = stages["simhash_near_dedup"](spark, good, SF)
    kept = {rows[i][0]: rows[i][1] for i in range(len(rows)) if own[i] == i}
    assert {r.doc_id: r.text or "" for r in single.collect()} == kept
    # 3: spans by a count over all texts, replaced
    ids_of = sorted(kept)
    spans = dict(zip(ids_of, disclosed_by_loop([kept[i] for i in ids_of])))
    clean = stages["pii"](spark, single, SF)
    want = {i: pii.rewrite(kept[i], spans[i]) for i in ids_of}
    got = {r.doc_id: (r.text or "", r.n_chars) for r in clean.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert not any(pii.base_spans(t) for t in want.values() if "[" not in t)
    # 4: every row as often as the mix takes it, targets met within one document
    mixed = stages["source_mixing"](spark, clean, SF)
    taken = Counter(r.doc_id for r in mixed.collect())
    counts = {r.doc_id: (r.source, r["size"], r.target, r.copies) for r in mixing.mix(clean).collect()}
    assert {i: n for i, n in taken.items()} == {i: c for i, (_, _, _, c) in counts.items() if c}
    for source in {s for s, *_ in counts.values()}:
        mine = [c for c in counts.values() if c[0] == source]
        assert abs(sum(size * n for _, size, _, n in mine) - mine[0][2]) <= max(size for _, size, _, _ in mine) / 2 + 1e-6
    # 5: the library's ids
    coded = stages["bpe"](spark, mixed, SF)
    assert Counter((r.doc_id, bytes(r.ids)) for r in coded.collect()) == Counter({(i, ids(library, want[i])): n for i, n in taken.items()})


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "source_mixing", "bpe"]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
    rows = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count() and kept <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_no_broadcast_of_the_pivot_rows(spark, tmp_path):
    # Few bytes on disk, but 28 rows a fingerprint.
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_broadcast_of_keys_or_their_pairs(spark, monkeypatch):
    from callscope.llm import resemblance

    plans, inner = {}, resemblance.materialise

    def materialise(df, label, *more):
        plans.setdefault(label, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return inner(df, label, *more)

    monkeypatch.setattr(resemblance, "materialise", materialise)
    r = random.Random(8)
    texts = [" ".join(r.choices(("one", "two", "three", "four", "five", "six"), k=30)) for _ in range(40)]
    resemblance.near_copies(spark.createDataFrame([(i, t + (" x" if i >= 40 else "")) for i, t in enumerate(texts * 2)], "doc_id long, text string"))
    assert "SortMergeJoin" in plans["members"][-1] and "Broadcast" not in plans["members"][-1]
    assert "arrays_overlap" in plans["candidate-pairs"][-1]
    assert any("SortMergeJoin" in line and "arrays_overlap" in line for line in plans["candidate-pairs"][-1].splitlines())
