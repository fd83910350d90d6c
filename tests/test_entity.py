"""The similarity join under hot tokens, leader clusters and appended rows against loops."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import entity

SETS = "set_id long, year int, number string, tokens array<string>"


def jaccard(a, b):
    return len(a & b) / len(a | b)


def greedy(sets, least):
    """(id, year, number, tokens) in order -> id: leader."""
    leaders, out = [], {}
    for i, year, number, tokens in sorted(sets, key=lambda s: s[0]):
        t = set(tokens)
        fit = next((j for j, y, n, u in leaders if y == year and not (number and n and number != n) and jaccard(t, u) >= least), None)
        out[i] = i if fit is None else fit
        if fit is None:
            leaders.append((i, year, number, t))
    return out


def random_sets(seed, n, words, most=9):
    r = random.Random(seed)
    seen, out = set(), []
    for i in range(n):
        tokens = tuple(sorted({words[min(len(words) - 1, int(r.expovariate(0.25)))] for _ in range(r.randint(1, most))}))
        key = (r.choice([None, 2025, 2026]), r.choice([None, None, "num1", "num2"]), tokens)
        if key not in seen:
            seen.add(key)
            out.append((i, *key))
    return out


@pytest.mark.parametrize("hot", [1, 3, 100])
@pytest.mark.parametrize("least", [0.6, 0.72, 0.9])
def test_pairs_by_brute_force(spark, monkeypatch, hot, least):
    monkeypatch.setattr(entity, "HOT", hot)
    sets = random_sets(hot, 150, [f"w{i}" for i in range(25)])
    want = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and a[1] == b[1] and not (a[2] and b[2] and a[2] != b[2]) and jaccard(set(a[3]), set(b[3])) >= least}
    got = {(r.a, r.b) for r in entity.similar_pairs(spark.createDataFrame(sets, SETS), least).collect()}
    assert got == want and want


def test_a_word_in_every_set_pairs_nothing(spark, monkeypatch):
    """Candidates grow with the rows where two words stand in every set and few others are shared."""
    monkeypatch.setattr(entity, "HOT", 10)
    sizes = []
    for n in (150, 600):
        r = random.Random(1)
        sets = [(i, 2026, None, ["call", "edital", *sorted({f"t{r.randint(0, 10 * n)}" for _ in range(2)})]) for i in range(n)]
        lines = entity._lines(spark.createDataFrame(sets, SETS))
        fits = F.col("x.set_id") < F.col("y.set_id")
        sizes.append(entity._candidates(lines, 0.5, ("year",), fits).count())
    assert sizes[1] <= 8 * max(sizes[0], 10)


def test_keys_grow_with_the_sets_where_every_token_is_shared(spark, monkeypatch):
    """Sets of 40 of 46 words: a key of one token has most sets, and there are half a thousand keys of three a set."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(46)]
    sets = [(i, 2026, None, sorted(r.sample(words, 40))) for i in range(130)]
    keys = []
    monkeypatch.setattr(entity, "kept", lambda df, label, f=entity.kept: (keys.append(df.count()) if label == "set-keys" else None) or f(df, label))
    want = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and jaccard(set(a[3]), set(b[3])) >= 0.8}
    assert {(x.a, x.b) for x in entity.similar_pairs(spark.createDataFrame(sets, SETS), 0.8).collect()} == want and want
    assert sum(keys) <= 130 * 10


def test_followers_by_folds_and_rounds(spark):
    r = random.Random(2)
    edges = sorted({tuple(sorted(r.sample(range(120), 2))) for _ in range(130)})
    near = {}
    for a, b in edges:
        near.setdefault(b, []).append(a)
    want, leads = {}, set()
    for i in range(120):
        first = next((a for a in sorted(near.get(i, [])) if a in leads), None)
        if first is None:
            leads.add(i)
        else:
            want[i] = first
    frame = spark.createDataFrame(edges, "a long, b long")
    for fold in (entity.FOLD, 6, 0):
        assert {x.set_id: x.leader for x in entity.followers(frame, fold).collect()} == want
    assert entity.followers(frame.limit(0)).count() == 0


def test_a_chain_of_sets_settles_in_few_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(200)]
    written = []
    from callscope.operators import components

    for module in (entity, components):
        monkeypatch.setattr(module, "kept", lambda df, label, f=module.kept: written.append(label) or f(df, label))
    got = {x.set_id: x.leader for x in entity.followers(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i - 1 for i in range(1, 201, 2)}
    assert written.count("labels") <= 10


def test_clusters_of_hot_titles_and_appended_rows(spark, monkeypatch):
    monkeypatch.setattr(entity, "HOT", 4)
    r = random.Random(4)
    words = [f"palavra{i}" for i in range(30)]
    titles = [(i, " ".join(["chamada", *r.sample(words[: r.choice([4, 8, 30])], r.randint(0, 4)), *([str(r.choice([2025, 2026]))] if r.random() < 0.5 else [])])) for i in range(200)] + [(200, None), (201, "")]
    frame = spark.createDataFrame(titles, "position long, title string")
    marked = [(x.position, x.year, x.number, x.tokens) for x in entity.tokenised(frame, "title").collect()]
    want = greedy([m for m in marked if m[3]], 0.7) | {m[0]: m[0] for m in marked if not m[3]}
    whole = entity.leader_clusters(frame, "title", "position", 0.7)
    assert {x.position: x.leader for x in whole.collect()} == want
    first, later = frame.filter("position < 120"), frame.filter("position >= 120")
    known = entity.leader_clusters(first, "title", "position", 0.7).filter("leader = position").select("position", "title")
    got = entity.leader_clusters(later, "title", "position", 0.7, known)
    assert {x.position: x.leader for x in got.collect()} == {p: q for p, q in want.items() if p >= 120}


def test_editions_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(entity, "HOT", 3)
    r = random.Random(6)
    title = lambda: " ".join(r.sample(["apoio", "bolsas", "clima", "mares", "saude", "arte"], r.randint(1, 4)) + ([str(r.randint(2020, 2026))] if r.random() < 0.9 else []))
    rows = [(i, title(), f"u{i}") for i in range(120)]
    frame = spark.createDataFrame(rows, "position long, title string, url string")
    from callscope.functions.text import signature_tokens, without_year, year_of

    marked = [(x.position, x.url, x.y, set(x.t)) for x in frame.select("position", "url", year_of(F.col("title")).alias("y"), signature_tokens(without_year(F.col("title"))).alias("t")).collect()]
    want = {}
    for p, _, y, t in marked:
        older = [(jaccard(t, u), -q, v, z) for q, v, z, u in marked if y and z and z < y and t and u and jaccard(t, u) >= 0.75]
        want[p] = max(older)[2:] if older else (None, None)
    assert {x.position: (x.previous_url, x.previous_year) for x in entity.previous_editions(frame, frame).collect()} == want
    none = entity.previous_editions(frame, frame.limit(0))
    assert none.count() == 120 and none.filter("previous_url is not null").count() == 0


def test_only_editions_that_may_be_the_best_are_met(spark):
    """Of 40 older editions as like as each other a row meets the first alone; what is left gives any row the best before it."""
    r = random.Random(9)
    pairs = [(2026, ["a"], o, 0.8, 40 - o) for o in range(40)] + [(2025, ["b"], o, r.choice([0.75, 0.8, 0.9, 1.0]), 40 - o) for o in r.sample(range(40), 20)]
    left = [tuple(x) for x in entity.front(spark.createDataFrame(pairs, "year int, tokens array<string>, o int, likeness double, __rank int")).collect()]
    assert [x[2] for x in left if x[0] == 2026] == [0]
    for at in range(41):
        best = lambda rows: max(((x[3], x[4], x[2]) for x in rows if x[0] == 2025 and x[2] < at), default=None)
        assert best(left) == best(pairs)
