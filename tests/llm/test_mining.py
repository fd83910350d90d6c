"""URL filters, phrase collocations and the filter audit against brute force and edge cases."""

import itertools
import random
import re
import string
from collections import Counter, defaultdict

import oracle
import pytest

from callscope.llm import audit, catalog, collocations, hosts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_phrase_collocations", "op13_filter_audit"])
def test_matches_oracle(spark, name):
    assert oracle.difference(spark, name, SF, catalog.QUERIES, catalog.ORACLE_SQL) == ""


# 11


PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string, kind string, mass string, src string"
URLS = [
    (None, ("", "")), ("no scheme/x", ("", "")), ("http://A.B.com", ("a.b.com", "")), ("https://WWW.Example.com/en/x?y=1", ("www.example.com", "/en/x")), ("x http://h.net/es/?a://b", ("h.net", "/es/")),
    ("http://é.NET/fr/#t", ("é.net", "/fr/")), ("http://?q", ("", "")), ("http://h:80/a\n/b?c", ("h:80", "/a\n/b")), ("ftp://h/a//b://c", ("h", "/a//b://c")), ("http://h#://x", ("h", "")),
]


def test_hosts_and_paths(spark):
    rows = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(URLS)], "page_id long, url string, html string")
    assert {r.page_id: (r.host, r.path) for r in hosts.located(rows).collect()} == {i: want for i, (_, want) in enumerate(URLS)}


def test_rules_by_brute_force(spark):
    r = random.Random(3)
    labels, steps = ["a", "b", "www", "com", "net", "x"], ["/", "/e", "/en/", "/en/x", ""]
    rules = list({(r.choice(["allow", "block"]), ".".join(r.choices(labels, k=r.randint(1, 3))), r.choice(steps)) for _ in range(60)})
    places = [(i, ".".join(r.choices(labels, k=r.randint(1, 5))), r.choice(steps) + r.choice(["", "q", "n/x"])) for i in range(400)] + [(400, "", "")]

    def judged(host, path):
        fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    got = hosts.by_rules(spark.createDataFrame(places, "page_id long, host string, path string"), rules)
    assert {x.page_id: (x.verdict, x.rule) for x in got.collect()} == {i: judged(h, p) for i, h, p in places}


def propagated_by_loop(edges, seeds, rounds):
    out = {}
    for kind in ("trust", "distrust"):
        pairs = edges if kind == "trust" else [(b, a) for a, b in edges]
        nexts = defaultdict(list)
        for a, b in pairs:
            nexts[a].append(b)
        own = {h: n for (k, h), n in seeds.items() if k == kind}
        start = {h: hosts.TOTAL // sum(own.values()) * n for h, n in own.items()}
        mass = start
        for _ in range(rounds):
            moved = Counter({h: m * (100 - hosts.FOLLOW) // 100 for h, m in start.items()})
            for h, m in mass.items():
                for b in nexts[h]:
                    moved[b] += m * hosts.FOLLOW // 100 // len(nexts[h])
            mass = moved
        out |= {(kind, h): m for h, m in mass.items()}
    return out


def test_propagation_by_brute_force(spark):
    r = random.Random(5)
    names = [f"h{i}.org" for i in range(40)]
    edges = sorted({(a, b) for a, b in (r.sample(names, 2) for _ in range(150))} | {(a, "hub.org") for a in names[:30]})
    seeds = {("trust", "h1.org"): 3, ("trust", "h2.org"): 4, ("distrust", "h9.org"): 5, ("distrust", "h1.org"): 1}
    frame = spark.createDataFrame([(k, h, n) for (k, h), n in seeds.items()], "kind string, host string, n long")
    mass = hosts.propagated(spark.createDataFrame(edges, "src string, dst string"), frame, 4)
    got = {(x.kind, x.host): x.mass for x in mass.collect()}
    want = propagated_by_loop(edges, seeds, 4)
    assert got == {k: m for k, m in want.items() if k in got} and all(m == 0 for k, m in want.items() if k not in got)
    bad = {x.host for x in hosts.distrusted(mass).collect()}
    assert bad == {h for h in {h for _, h in want} if want.get(("distrust", h), 0) > want.get(("trust", h), 0)} and bad


def test_links_spread_distrust_and_trust(spark):
    pages = [
        (1, "http://spam.net/es/a", "x"),
        (2, "http://friend.org/a", "<a href='http://spam.net/es/a'>x</a>"),
        (3, "http://good.com/", '<a HREF = "//liked.org/b?c">x</a> <a href=http://good.com/self>'),
        (4, "http://liked.org/", None),
        (5, "http://lonely.org/", ""),
        (6, None, "<a href='http://liked.org/'>"),
        (7, "http://blog.spam.net/en/", ""),
    ]
    got = {x.page_id: (x.verdict, x.decided_by) for x in hosts.judge(spark.createDataFrame([(*p, *["z"] * 7) for p in pages], PAGES)).collect()}
    assert got == {1: ("block", "rule"), 2: ("block", "links"), 3: ("allow", "rule"), 4: ("allow", "default"), 5: ("allow", "default"), 6: ("allow", "default"), 7: ("block", "links")}
    assert not [x for x in hosts.judge(spark.createDataFrame([(*p, *["z"] * 7) for p in pages], PAGES), bonds=False).collect() if x.page_id == 7 and x.verdict == "block"]


def test_url_filter_edges(spark):
    empty = spark.createDataFrame([], PAGES)
    assert hosts.judge(empty).count() == 0
    same = [(1, "http://a.net/es/", "<a href='http://b.org/'>", *["z"] * 7)] * 5 + [(None, "http://b.org/", None, *["z"] * 7)]
    rows = hosts.judge(spark.createDataFrame(same, PAGES)).collect()
    assert Counter((x.page_id, x.verdict) for x in rows) == {(1, "block"): 5, (None, "allow"): 1}


# 12


def mined_by_loop(rows, least, cover=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in found.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 1 < j - i < len(p):
                    covered[p[i:j]] = max(covered[p[i:j]], a)
        ranked = []
        for p, a in found.items():
            if 100 * covered[p] >= cover * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


TEXTS = "lang string, text string, doc_id string, phrase string, f string, block string, n string, rank string, id string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(spark, rows, least, **more):
    found = collocations.mine(spark.createDataFrame([(*r, *["z"] * 7) for r in rows], TEXTS).repartition(3), least, **more)
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def test_phrases_by_brute_force(spark, monkeypatch):
    r = random.Random(1)
    words = ["a", "b", "A", "new", "york", "é", "É", "\x1c", "\x85", " ", "x\u2028y"]
    rows = [(r.choice(["en", "de", None, ""]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", "\n", "\x0b", ".", "!"]) for _ in range(r.randint(0, 60)))) for _ in range(200)]
    rows += [("en", None), ("fr", ""), ("xx", " .,; "), *[("en", "new york city hall new york city hall")] * 7, *[("de", "tie one. tie two")] * 6]
    for least in (5, 12):
        want = mined_by_loop(rows, least)
        assert mined(spark, rows, least) == want and len(want) > 10
        # Names are joined by key where there are too many for a broadcast.
        with monkeypatch.context() as m:
            m.setattr(collocations, "HELD_NAMES", 3)
            assert mined(spark, rows, least) == want
    assert mined(spark, rows, 5, top=3) == mined_by_loop(rows, 5, top=3)


def test_very_long_text_is_cut_without_loss(spark):
    r = random.Random(2)
    text = " ".join(r.choice("abcdefgh") for _ in range(collocations.BLOCK + 1000))
    rows = [("en", text), ("en", "a b c d " * 100)]
    assert mined(spark, rows, 100) == mined_by_loop(rows, 100)


def test_long_text_at_the_cut(spark):
    text = "p " * (collocations.BLOCK - 2) + "q r s t"
    got = collocations.phrases(spark.createDataFrame([("en", text)], "lang string, text string"), 1)[0]
    found = {x.phrase: x.f for level in got for x in level.collect()}
    assert found["q r s t"] == found["p q r s"] == found["p p q r"] == 1 and found["q r"] == found["r s t"] == 1 and found["p p"] == collocations.BLOCK - 3


def test_phrase_edges(spark):
    assert collocations.mine(spark.createDataFrame([], TEXTS)).count() == 0
    assert mined(spark, [("en", None), (None, "one two")], 30) == []
    assert collocations.mine(spark.createDataFrame([("en", "x y " * 40)] * 3, "lang string, text string")).count() > 0


# 13


def audited_by_loop(docs, labels):
    good, toxic = ({d for d, *v in labels if v[i] == 1} for i in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails = []
    for d, text, lang in docs:
        t = text or ""
        words = re.findall("[^ \t\n-\r]+", t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d}
        fails.append((lang or "", {f for f in own if own[f]}, d in good, d in toxic))
    out = {}
    parts = {p for p, *_ in fails}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    shapley = Counter()
    for order in orders:
        for part, own, *_ in fails:
            if own:
                shapley[part, next(f for f in order if f in own)] += 1
    for part in parts:
        mine = [x for x in fails if x[0] == part]
        for order in orders:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, order, step] = (len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), shapley[part, f])
    return out


DOCS = "doc_id long, text string, lang string, fp string, mask string, part string, least string, grp string, n string, good string"


def audited(spark, docs, labels, parts=5):
    frame = spark.createDataFrame([(*d, *["z"] * 7) for d in docs], DOCS).repartition(parts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit.interactions(audit.counters(audit.failure_masks(frame), marks))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows.collect()}


def test_audit_by_brute_force(spark):
    r = random.Random(4)
    rare = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 199, 200, 250]))) + r.choice(["", " #", " X" * 30, " é\u2028x"]) for _ in range(30)]
    pool = [*rare, "", None, "same same same", "Ä" * 50 + "ABC"]
    docs = [(r.choice([i, i, i, None, r.randint(0, 50)]), r.choice(pool), r.choice(["en", "de", None, ""])) for i in range(300)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == audited_by_loop(docs, labels)


def test_copies_over_many_ranges(spark):
    """One text in most rows spans every range; another fingerprint's group ends inside a range."""
    docs = [(i, "copy of one text", "en") for i in range(4000)] + [(i, "other", "en") for i in range(0, 4000, 7)] + [(i, f"text {i}", "de") for i in range(100)]
    random.Random(1).shuffle(docs)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(*d, *["z"] * 7) for d in docs], DOCS).repartition(5)
        failed = audit.failure_masks(frame).filter(f"mask & {audit.DUPLICATE} <> 0")
        assert failed.count() == 3999 + len(range(0, 4000, 7)) - 1 and failed.select("doc_id").filter("doc_id = 0").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_audit_edges(spark):
    assert audited(spark, [], []) == {}
    docs = [(1, None, None), (1, None, None), (None, "", "x"), (2, "", "en")]
    assert audited(spark, docs, [(1, 1, 1)]) == audited_by_loop(docs, [(1, 1, 1)])


def test_equal_fingerprints_of_different_texts():
    """Groups are told apart by text: fingerprints are forced to be equal, ranges begin and end inside."""
    import pyarrow as pa

    def run(rows, part):
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["fp", "doc_id", "part", "text"])
        original, audit.TaskContext = audit.TaskContext, type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: part)}))})
        try:
            return [x for b in audit._masks(iter([batch.slice(0, 2), batch.slice(2)])) for x in b.to_pylist()]
        finally:
            audit.TaskContext = original

    out = run([(7, 1, "p", "a"), (7, 5, "p", "a"), (7, 3, "p", "b"), (8, 2, "p", "c"), (9, 4, "p", "d"), (9, 6, "p", "e")], 2)
    edges = [(x["text"], x["least"]) for x in out if x["text"] is not None]
    assert edges == [("a", 1), ("b", 3), ("d", 4), ("e", 6)]
    assert [x["least"] for x in out if x["text"] is None] == [1, 1, 3, 2, 4, 6] and len({x["grp"] for x in out}) == 5
