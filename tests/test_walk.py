"""Page walks and runs over sources against a loop that reads page after page."""

import random

from pyspark.sql import functions as F

from callscope.operators import walk


def walked_by_loop(start, way, first, most, pages, listed):
    """pages: url -> {number: target, None: target by label}; listed: url -> [(item, relevant)]."""
    address = lambda n: start.replace("{pagina}", str(n)) if way == "template" else start.split("?")[0] + f"?pg={n}"
    url, number, seen, met, out = start if way == "auto" else address(first), first, set(), set(), []
    for turn in range(most):
        if url in met:
            out[-1][3] = "repeat"
            break
        met.add(url)
        if url not in pages:
            out.append([turn, url, 0, "failed"])
            break
        new = {i for i, ok in listed.get(url, []) if ok} - seen
        out.append([turn, url, len(new), None])
        if turn and not new:
            out[-1][3] = "nothing new"
            break
        seen |= new
        if not listed.get(url):
            out[-1][3] = "empty"
            break
        onward = address(number + 1) if way != "auto" else pages[url].get(number + 1, pages[url].get(None))
        if onward is None:
            out[-1][3] = "no next"
            break
        url, number = onward, number + 1
    else:
        out[-1][3] = out[-1][3] or "cap"
    return out, seen


def world(seed):
    r = random.Random(seed)
    urls = [f"https://h.org/p{i}" for i in range(12)] + [f"https://h.org/list?pg={i}" for i in range(5)] + [f"https://h.org/t/{i}" for i in range(5)]
    pages = {u: {} for u in urls if r.random() < 0.9}
    for u in pages:
        others = [x for x in urls if x != u]
        if r.random() < 0.5:
            pages[u][r.randint(1, 5)] = r.choice(others)
        if r.random() < 0.6:
            pages[u][None] = r.choice(others)
    listed = {u: [(f"i{r.randint(0, 25)}", r.random() < 0.7) for _ in range(r.choice([0, 1, 3, 6]))] for u in pages}
    return r, urls, pages, listed


def frames(spark, pages, listed):
    html = lambda links: "".join(f"<a href='{t}#x'>{n or 'próxima'}</a>" for n, t in links.items())
    frame = spark.createDataFrame([(u, html(x)) for u, x in pages.items()], "url string, html string")
    items = spark.createDataFrame([(u, i, x, ok) for u, xs in listed.items() for i, (x, ok) in enumerate(xs)], "page string, position int, url string, relevant boolean")
    return frame, items


STARTS = "source string, place int, start string, way string, parameter string, first int, most int"


def test_walks_by_brute_force(spark):
    for seed in range(3):
        r, urls, pages, listed = world(seed)
        starts = [(f"s{i}", 0, r.choice(urls + ["https://h.org/none"]), "auto", None, r.choice([1, 1, 2]), r.choice([1, 3, 6])) for i in range(25)]
        starts += [("q", 0, "https://h.org/list?pg=9", "query", "pg", 0, 4), ("t", 0, "https://h.org/t/{pagina}", "template", None, 1, 9)]
        frame, items = frames(spark, pages, listed)
        got, found = walk.walks(spark.createDataFrame(starts, STARTS), *walk.read_once(frame, items), items)
        rows = {}
        for x in got.orderBy("source", "turn").collect():
            rows.setdefault(x.source, []).append([x.turn, x.url, x.n_new, x.stop])
        by_source = {s: {x.url for x in found.filter(F.col("source") == s).collect()} for s in ("s0", "s1", "q", "t")}
        for source, _, start, way, _, first, most in starts:
            want, seen = walked_by_loop(start, way, first, most, pages, listed)
            assert rows[source] == want, (source, rows[source], want)
            assert by_source.get(source, seen) == seen


def test_run_over_sources_by_brute_force(spark):
    for seed in (7, 8):
        r, urls, pages, listed = world(seed)
        sources = [(f"s{i}", r.sample(urls + ["https://h.org/none"], 3), r.random() < 0.5, "auto", None, 1, 3) for i in range(12)]
        memory = [("s0", sources[0][1][2]), ("s1", "https://h.org/p0"), ("s2", "https://h.org/gone"), ("zz", "https://h.org/p1")]
        frame, items = frames(spark, pages, listed)
        schema = "source string, urls array<string>, read_all boolean, way string, parameter string, first int, most int"
        got, used, attempts = walk.read_sources(spark.createDataFrame(sources, schema), spark.createDataFrame(memory, "source string, url string"), frame, items)
        kept, good = {}, {x.source: x.url for x in used.collect()}
        for x in got.collect():
            kept.setdefault(x.source, set()).add(x.url)
        for source, own, read_all, *_ in sources:
            order = list(dict.fromkeys([u for s, u in memory if s == source] + own))
            runs = [(u, *walked_by_loop(u, "auto", 1, 3, pages, listed)) for u in order]
            answered = [(u, seen) for u, way, seen in runs if way[0][3] != "failed"]
            if read_all:
                items_of, best = set().union(*[seen for _, seen in answered]), answered[0][0] if answered else None
            else:
                full = [(u, seen) for u, seen in answered if seen]
                items_of, best = (full[0][1], full[0][0]) if full else (set(), answered[0][0] if answered else None)
            assert kept.get(source, set()) == items_of and good.get(source) == best
        assert attempts.count() == sum(len(set([u for s, u in memory if s == source] + own)) for source, own, *_ in sources)


def test_walk_edges(spark):
    frame, items = frames(spark, {"https://h.org/a": {None: "https://h.org/a"}}, {})
    none = spark.createDataFrame([], STARTS)
    pages, found = walk.walks(none, *walk.read_once(frame, items), items)
    assert pages.count() == found.count() == 0
    starts = spark.createDataFrame([("s", 0, "https://h.org/a#top", "auto", None, 1, 5)], STARTS)
    assert [(x.n_raw, x.n_new, x.stop) for x in walk.walks(starts, *walk.read_once(frame.unionByName(frame), items), items)[0].collect()] == [(0, 0, "empty")]
