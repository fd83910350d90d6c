"""Block extraction, the collection run and the small rules around them."""

from pyspark.sql import functions as F

from callscope.functions import text as T
from callscope.operators import extraction, history, panel, scoring
from callscope.operators import lexicon as L
from callscope.plans import collect
from callscope.sources import blocks

PAGE = "page_id long, url string, html string"
CARD = "<article class='card'><h2>Chamada de mobilidade academica</h2><p class='when'>ate 1/10/2026</p><a href='/c'>Chamada de cooperacao internacional</a><a href='https://wa.me/1'>Compartilhe</a></article>"


def items(spark, html, css, **more):
    frame = spark.createDataFrame([(1, "https://a.org/list", html)], PAGE)
    return sorted(extraction.listing_items(frame, css, **more).collect(), key=lambda r: r.position)


def test_selectors():
    page = blocks.Page("<ul id=u><li class='a b'><p data-x>1<p>2</ul><li>3")
    found = lambda css: [page.text_of(n) for n in page.nodes if blocks.matches(n, blocks.selector(css))]
    assert found("li.a.b") == ["12"] and found("ul > li") == ["12"] and found("ul p") == ["1", "2"] and found("ul > p") == []
    assert found("#u p[data-x], body") == ["1"] and found("li") == ["12", "3"] and found("*") == ["12", "12", "1", "2", "3"]
    assert [blocks.selector(s) for s in (None, "", "li:first-child", "> a", "a >", "a,,b")] == [None] * 6


def test_pages_that_cannot_be_read(spark):
    deep = "<div>" * 3000 + "<a href='/x'>Edital de bolsas de pesquisa</a>"
    assert blocks.links_of(None, "div", None, None) == [] and len(blocks.links_of(deep, None, None, None)) == 1
    assert items(spark, None, "li") == [] and items(spark, "", "li:bad") == []
    assert extraction.listing_items(spark.createDataFrame([], PAGE), "li").count() == 0


def test_block_strategy_and_share_links(spark):
    rows = items(spark, CARD.replace("/c", "/1") + CARD.replace("/c", "/2") + CARD.replace("/c", "/3"), ".card", date_css=".when", group=False)
    assert [(r.strategy, r.url, r.date_text) for r in rows] == [("selector", f"https://a.org/{i}", "ate 1/10/2026") for i in (1, 2, 3)]
    assert all(r.title == "Chamada de cooperacao internacional" and "mobilidade" in r.context for r in rows)


def test_scan_takes_headings_of_ancestors(spark):
    html = "<body><div><h3>Edital de intercambio na Europa</h3><p><a href='f.pdf'>Baixar</a></p></div><div><a href='/n' aria-label='Programa de doutorado sanduiche'>+</a></div><a href='https://b.net/x'>Outro portal de noticias</a><a href='/n'>again</a></body>"
    rows = items(spark, html, None)
    assert [(r.strategy, r.title, r.url, r.file) for r in rows] == [("scan", "Edital de intercambio na Europa", "https://a.org/f.pdf", "PDF"), ("scan", "Programa de doutorado sanduiche", "https://a.org/n", "")]


def test_gates_of_a_run(spark):
    good = "International joint research call with mobility grants. Application deadline 2026-10-01."
    rows = spark.createDataFrame(
        [("s", 0, "Noticias", "u0", good), ("s", 1, "Edital de bolsas 2019", "u1", good), ("s", 2, "Projeto conjunto", "u2", good), ("s", 3, "Projeto conjunto", "u3", None), (None, 4, None, "u4", good), ("t", 5, "Projeto conjunto", "u5", "International joint research call with mobility grants.")],
        "source string, position long, title string, url string, context string",
    )
    sources = spark.createDataFrame([("s", False, 1), ("s2", None, None)], "source string, need_date boolean, max_details int")
    details = spark.createDataFrame([("u2", good), ("u2", good), ("u5", "Apply by October 1, 2026."), ("u3", None)], "url string, text string")
    judged = collect.judged(rows, sources, details, "2026-08-20")
    got = {r.position: (r.reason, r.detail_read) for r in judged.collect()}
    assert len(got) == 6 and got[0][0] == "navigation" and got[1][0] == "past edition" and got[2] == (None, True)
    assert got[3] == ("not prequalified", False) and got[4][0] == "navigation" and got[5] == (None, True)
    assert {r.position for r in collect.accepted(judged).collect()} == {2, 5}
    assert sum(r.n for r in collect.discards(judged).collect()) == 6
    assert collect.judged(rows.limit(0), sources, details, "2026-08-20").count() == 0


def test_score_without_axis(spark):
    n = T.normalise(F.lit("Nothing of note stands here"))
    score = scoring.prequalify_score(n, scoring.axis_hits(n, L.PROFILE), L.PROFILE)
    assert spark.range(1).select(score.alias("x")).first().x == 0


def test_small_rules(spark):
    keys = [t.key for t in sorted(L.THEMES, key=lambda t: t.priority)]
    one = spark.range(1).select(
        scoring.merged_themes(F.array(F.lit(keys[-1])), F.array(F.lit(keys[0]), F.lit("unknown"), F.lit(keys[-1]))).alias("themes"),
        scoring.eligibility(scoring.with_public_only(scoring.restrictions(F.lit(""), F.lit("")), F.lit(True))).alias("blocked"),
        scoring.eligibility(scoring.with_public_only(scoring.restrictions(F.lit(""), F.lit("")), F.lit(None).cast("boolean"))).alias("free"),
        panel.label("status", F.lit("aberto")).alias("shown"),
        panel.label("status", F.lit("other")).alias("unknown"),
        panel.is_new(F.lit(None).cast("timestamp"), F.current_timestamp()).alias("never"),
    ).first()
    assert one.themes == [keys[0], keys[-1]] and (one.blocked, one.free) == ("restricao_conhecida", "sem_catalogo")
    assert (one.shown, one.unknown, one.never) == ("Aberto confirmado", "other", False)
    assert panel.active_filters("open", "es", None, ("a", "a"), " x ") == 3
    runs = spark.createDataFrame([], history.RUNS)
    first = history.append_run(runs, F.lit("2026-01-01"), F.lit(1), F.lit(2))
    assert [r.number for r in first.collect()] == [1] and history.append_run(first, F.lit("2026-01-02"), F.lit(0), F.lit(2), keep=1).first().number == 2


def test_previous_editions_by_brute_force(spark):
    import random

    from callscope.operators import entity

    r = random.Random(9)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    titles = [f"Chamada mobilidade {' '.join(r.sample(words, r.randint(1, 4)))} {r.choice((2022, 2023, 2024, 2025))}" for _ in range(60)] + ["Sem ano algum aqui", ""]
    rows = spark.createDataFrame([(i, t, f"u{i:03d}") for i, t in enumerate(titles)], "position long, title string, url string")
    known = {x.position: (x.y, set(x.t)) for x in rows.select("position", T.year_of(F.col("title")).alias("y"), T.signature_tokens(T.without_year(F.col("title"))).alias("t")).collect()}
    want = {}
    for i, (year, tokens) in known.items():
        older = [(len(tokens & u) / len(tokens | u), -j) for j, (y, u) in known.items() if year and y and y < year and tokens and u and len(tokens & u) / len(tokens | u) >= 0.75]
        want[i] = f"u{-max(older)[1]:03d}" if older else None
    assert {x.position: x.previous_url for x in entity.previous_editions(rows, rows).collect()} == want


def test_deadline_at_the_end_of_a_long_detail_page(spark):
    rows = spark.createDataFrame([("t", 5, "Projeto conjunto", "u5", "International joint research call with mobility grants.")], "source string, position long, title string, url string, context string")
    sources = spark.createDataFrame([("t", None, None)], "source string, need_date boolean, max_details int")
    details = spark.createDataFrame([("u5", "filler text " * 16_000 + ". Apply by October 1, 2026.")], "url string, text string")
    (row,) = collect.judged(rows, sources, details, "2026-08-20").collect()
    assert row.reason is None and row.detail_read


def test_accented_candidates_are_judged_like_plain_ones(spark):
    plain = "Chamada de cooperacao internacional com mobilidade academica e bolsas. Inscricoes ate 10/10/2026."
    accented = "Chamada de cooperação internacional com mobilidade acadêmica e bolsas. Inscrições até 10/10/2026."
    rows = spark.createDataFrame([("s", i, "Projeto conjunto", f"u{i}", t) for i, t in enumerate((plain, accented))], "source string, position long, title string, url string, context string")
    sources = spark.createDataFrame([("s", None, None)], "source string, need_date boolean, max_details int")
    details = spark.createDataFrame([], "url string, text string")
    got = [(r.pre_score, r.score, r.reason, r.deadline) for r in collect.judged(rows, sources, details, "2026-08-20").orderBy("position").collect()]
    assert got[0] == got[1] and got[0][2] is None
