"""Behaviours of the text, deadline, scoring, extraction and history operators on texts of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from callscope.functions import dates, text
from callscope.operators import extraction, history, scoring
from callscope.sources import html, storage


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "value,day",
    [
        ("Prazo: 3/4/2027", dt.date(2027, 4, 3)),
        ("Deadline 2026-12-01 at noon", dt.date(2026, 12, 1)),
        ("Inscrições até 5 de março de 2027", dt.date(2027, 3, 5)),
        ("Apply by September 9th, 2026", dt.date(2026, 9, 9)),
        ("Submissões de 01/02/2027 até 28/02/2027", dt.date(2027, 2, 28)),
        ("prazo 31/02/2027", None),
        ("prazo 10/10/1999", None),
        ("Deadline 1 October 202 6", dt.date(2026, 10, 1)),
        ("", None),
        (None, None),
    ],
)
def test_deadline(spark, value, day):
    found = dates.with_deadline(spark.createDataFrame([(value,)], "x string"), "x").first().best
    assert (found.day if found else None) == day


@pytest.mark.parametrize(
    "value,status",
    [
        ("Chamada encerrada.", "encerrado"),
        ("Open call, apply now", "aberto"),
        ("Status: forthcoming", "futuro"),
        ("Nada sobre datas", "verificar"),
        ("Prazo 20/08/2026", "aberto"),
        ("Prazo 19/08/2026", "encerrado"),
        ("Resultado final e inscricoes abertas", "encerrado"),
    ],
)
def test_status(spark, value, status):
    rows = dates.with_status(spark.createDataFrame([(value,)], "t string"), "t", "2026-08-20")
    assert rows.first().status == status


def test_normalisers(spark):
    assert one(spark, "  Ação Nº\u00a05 — ﬁm  ", text.normalise(F.col("x"))) == "acao no 5 — fim"
    assert one(spark, "Pós-graduação!", text.normalise_words(F.col("x"))) == "pos graduacao"
    assert one(spark, None, text.normalise(F.col("x"))) == ""


def test_signature_keeps_year_and_number(spark):
    assert one(spark, "CHAMADA Mobility Italy Nº 02/2026", text.signature(F.col("x"))) == "2026 italy mobility num02"
    assert one(spark, "de da do", text.signature(F.col("x"))) == ""


def test_clean_title(spark):
    value = "<svg x='1'> Edital   de pesquisa aplicada Este edital abre tudo"
    assert one(spark, value, text.clean_title(F.col("x"), body_cues=(r"\s+Este\s+edital\s+",))) == "Edital de pesquisa aplicada"


def test_share_links(spark):
    rows = spark.createDataFrame([("https://www.linkedin.com/x", "a"), ("/edital/1", "Edital 1"), ("mailto:a@b.c", ""), ("/x", "Compartilhe no Facebook")], "h string, l string")
    page = F.lit("https://site.org/list")
    out = [r.n for r in rows.select(extraction.is_share_link(F.col("h"), extraction.resolve(page, F.col("h")), F.col("l")).alias("n")).collect()]
    assert out == [True, False, True, True]


def test_empty_mount_needs_script(spark):
    rows = spark.createDataFrame([(1, "<html><div id='root'></div><script>x</script></html>"), (2, "<p>" + "text " * 50 + "</p>")], "page_id long, html string")
    assert [r.needs_script for r in extraction.script_shell(rows).orderBy("page_id").collect()] == [True, False]


def test_html_text_reads_structured_deadlines():
    page = '<html><script type="application/ld+json">{"@type":"Grant","validThrough":"2026-10-15"}</script><script>var a="no";</script><p>Grant &amp; more</p></html>'
    assert html.text_of(page) == "deadline: 2026-10-15 Grant & more"
    assert html.text_of(None) == ""


def test_long_pages_and_blocks_are_whole():
    from callscope.sources import blocks

    long = "word " * 50_000
    assert html.text_of(f"<p>{long}</p><p>end</p>") == long + "end"
    (link, _) = blocks.links_of(f"<li><a href='/x'>Call</a> {long}<b>end</b></li>", "li", None, None)
    assert link["context"].endswith(" end")


def test_attachments_make_one_row(spark):
    rows = spark.createDataFrame([(1, "Edital 15/2026 de bolsas", "Anexo I", "u1", "PDF"), (2, "Edital 15/2026 de bolsas", "Edital completo", "u2", "PDF"), (3, "Edital 15/2026 de bolsas", "Formulario", "u3", "DOC")], "position int, header string, label string, url string, file string")
    (row,) = extraction.group_attachments(rows).collect()
    assert row.url == "u2" and [a.url for a in row.attachments] == ["u1", "u3"]


def test_history_keeps_demotes_and_changes(spark):
    batch = lambda *r: spark.createDataFrame(r, "key long, title string, status string, source string")
    first = history.upsert(spark.createDataFrame([], history.SCHEMA), batch((1, "Call A 2026", "aberto", "s"), (2, "Call B 2026", "aberto", "s"), (3, "Call C", "aberto", "t")), 1)
    ok = spark.createDataFrame([("s",)], "source string")
    second = {r.key: r for r in history.upsert(first, batch((1, "Call A 2027", "aberto", "s")), 2, ok).collect()}
    assert second[1].changes == ["title changed"] and second[1].changed_run == 2 and second[1].first_run == 1
    assert second[2].status == "verificar" and second[2].changes == [history.LOST]
    assert second[3].status == "aberto" and second[3].changed_run is None


def test_history_fields_repeats_and_turns(spark):
    schema = "key long, title string, status string, source string, position int, turn int, region string, points int, attachments array<string>, warnings array<string>"
    batch = lambda *r: spark.createDataFrame(r, schema)
    first = history.upsert(
        spark.createDataFrame([], history.SCHEMA),
        batch((1, "Old A", "futuro", "s", 0, 0, "es", 1, ["a"], []), (1, "Call A", "aberto", "t", 5, 1, "br", 2, ["b"], []), (2, "Call B", "aberto", "s", 1, 0, "es", 3, [], ["w"]), (3, "Call Italy mobility 2025", "encerrado", "s", 2, 0, "es", 4, [], [])),
        1,
    )
    assert {(r.key, r.title, r.status, r.source, r.region, r.points) for r in first.collect()} == {(1, "Call A", "aberto", "s", "br", 2), (2, "Call B", "aberto", "s", "es", 3), (3, "Call Italy mobility 2025", "encerrado", "s", "es", 4)}
    turns = spark.createDataFrame([("s", 0), ("t", 1)], "source string, turn int")
    second = history.upsert(
        first,
        batch((1, "", "aberto", "t", 0, 1, "xx", 9, [], []), (4, "Call Italy mobility 2027", "aberto", "s", 3, 0, "es", 4, [], []), (5, "Call Italy mobility 2026", "aberto", "s", 2, 0, "es", 4, [], []), (6, "Call Italy mobility 2026 again", "aberto", "s", 9, 0, "es", 4, [], [])),
        2,
        turns,
    )
    got = {r.key: r for r in second.collect()}
    assert len(got) == 6 and got[1].changes == ["status: verificar to aberto"] and (got[1].title, got[1].region, got[1].points, got[1].attachments) == ("Call A", "br", 9, ["b"])
    assert got[2].status == "verificar" and got[2].warnings == ["w", history.WARNING] and got[2].changes == [history.LOST]
    assert (got[4].new_edition_of, got[4].previous_year) == ("3", 2025) and (got[5].new_edition_of, got[5].previous_year) == ("3", 2025) and got[3].new_edition_of is None
    assert {r.n for r in second.filter("key in (4, 5)").select(history.novelty(2).alias("n")).collect()} == {"nova_edicao"}


def test_rule_tables_are_read(spark, tmp_path):
    import json

    from callscope.operators import lexicon

    write = lambda name, x: (tmp_path / name).write_text(json.dumps(x), "utf-8") and str(tmp_path / name)
    profile = lexicon.load_profile(write("p.json", {"_leia": "x", "limiar_aderencia": 25, "eixos": {"a": {"rotulo": "A", "peso": 9, "termos": ["Ação  Conjunta"], "temas": ["t"]}, "_n": {}}, "sinais_fomento": ["Bolsa"], "publicos": {"p": ["Aluno"], "_x": []}}))
    assert profile.axes == (lexicon.Axis("a", "A", 9, ("acao conjunta",), ("t",)),) and profile.funding == ("bolsa",) and profile.threshold == 25 and profile.audiences == {"p": ("aluno",)}
    themes, statuses, noise = lexicon.load_themes(write("t.json", {"temas_interesse": {"internacional": {"prioridade": 1, "palavras": ["Exterior"]}, "b": {"palavras": ["Pós-graduação"]}}, "status_edital": {"resultado": {"palavras": ["final"]}, "encerrado": {"palavras": ["fim"]}, "_l": "x"}, "ruido": {"palavras": ["Home"]}}))
    assert themes[0].words[0] == "exterior" and "germany" in themes[0].words and themes[1] == lexicon.Theme("b", 3, ("pos graduacao",))
    assert statuses == (("encerrado", ("fim",)), ("resultado", ("final",))) and noise == ("home",)
    rules, weights = lexicon.load_restrictions(write("r.json", {"restricoes": [{"programa": "P", "padrao": "x+", "exige": "y", "impacto": "bloqueia"}, {"programa": "Q", "padrao": "(x"}], "peso_por_fonte": {"_l": "x", "S": 1.2}}))
    assert rules == (lexicon.Restriction("P", "x+", "y", "bloqueia"),) and weights == {"S": 1.2}
    row = spark.createDataFrame([("Chamada em Germany", "https://x.org/chamada-1")], "t string, u string").select(scoring.classified(F.col("t"), F.col("u"), themes=themes, statuses=statuses, noise_words=noise).alias("c")).first().c
    assert row.tags == ["internacional"] and row.status == "aberto" and row.points == 18


def test_navigation_and_titles(spark):
    menus = ["Regimento interno da universidade", "Licitações e contratos do estado", "Bolsas no exterior", "Como funciona o programa", "Atas da comissão", "", None]
    calls = ["Edital 3 de pesquisa", "Chamada Transnacional Conjunta Biodiversa+ (BiodivConnect) para projetos de pesquisa", "Termo aditivo"]
    rows = spark.createDataFrame([(t,) for t in menus + calls], "t string")
    assert [r.m for r in rows.select(extraction.is_navigation(F.col("t")).alias("m")).collect()] == [True] * len(menus) + [False] * len(calls)


def test_inbound_only_is_not_relevant(spark):
    rows = spark.createDataFrame([("Chamada: estudantes internacionais podem cursar mestrado no Brasil, mobilidade academica internacional. Prazo 01/12/2026",)], "t string")
    row = scoring.evaluate(rows, "t", "2026-08-20").first()
    assert row.inbound_only and not row.relevant


def test_source_selection(spark):
    rows = spark.createDataFrame([("Agency", None), ("Agency North", True)], "name string, disabled boolean")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(storage.select_sources(rows, "agency")) == ["Agency"]
    assert names(storage.select_sources(rows, "north")) == ["Agency North"]
    assert names(storage.select_sources(rows, " ")) == ["Agency", "Agency North"]
    assert names(storage.active_sources(rows)) == ["Agency"]


def test_stream_follows_runs(spark, tmp_path):
    from callscope.streaming import incremental

    schema = "key long, title string, status string, source string"
    feed, root = tmp_path / "feed", f"file://{tmp_path}/history"
    for i, row in enumerate([(1, "A", "aberto", "s"), (1, "A", "encerrado", "s")]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(f"file://{feed}")
        stream = spark.readStream.schema(schema).json(f"file://{feed}")
        incremental.follow(stream, root, f"file://{tmp_path}/checkpoint").awaitTermination()
    (row,) = storage.read_current(spark, root).collect()
    assert row.status == "encerrado" and row.first_run == 1 and row.last_run == 2


def test_references_count_with_their_semicolon():
    from callscope.sources.html import text_of

    assert text_of("<h1>R&amp;D&amp;&amp</h1><p>a &copy 2026 &quot;b&quot; A&T</p>") == 'R&D&&amp a &copy 2026 "b" A&T'
    linked = '<script type="application/ld+json">{"deadline": "1 & 2 &amp 3"}</script>'
    assert text_of(linked + "x") == "deadline: 1 & 2 &amp 3 x"


def test_trees_find_what_alternations_find():
    import re

    from callscope.functions import cues
    from callscope.functions.text import any_pattern, any_prefix_pattern, prefix_pattern

    terms = ("open call", "open", "call open", "status: open", "a.b", "joint research", "research grant", "re")
    texts = ["the open calls", "status: openx", "axb", "a.b", "joint new big research", "joint a b c re search", "researc", "pre", "", *cues.CLOSED, *cues.DEADLINE, *terms]
    for some in (terms, terms[3:], terms[:1], cues.DEADLINE, cues.CLOSED):
        for t in texts:
            assert bool(re.search(any_pattern(some), t)) == any(x in t for x in some)
            assert bool(re.search(any_prefix_pattern(some), t)) == any(re.search(prefix_pattern(x), t) for x in some)
    for month in cues.MONTHS:
        assert re.search(rf"{any_pattern(cues.MONTHS, whole=True)}\b", f"de {month} de")[0] == month
    assert any_prefix_pattern(()) == ""


def test_long_rules_are_written_once(spark):
    """Filters on the status do not look for its cues again, and a text is brought to its words once for all themes."""
    from callscope.functions import dates
    from callscope.operators import scoring

    assert not any("rlike" in rule for rule in dates._STATUS.values())
    rows = spark.createDataFrame([("Joint research fellowship, mobilidade academica",), (None,), ("Grants abroad",)], "text string")
    found = rows.select(scoring.text_tags(F.col("text")).alias("tags"), scoring.theme_tags(text.normalise_words(F.col("text"))).alias("plain"))
    assert all(r.tags == r.plain for r in found.collect())
    assert scoring.text_tags(F.col("text"))._jc.toString().count("regexp_replace") < scoring.theme_tags(text.normalise_words(F.col("text")))._jc.toString().count("regexp_replace")


def test_classified_works_its_themes_out_once(spark):
    """F8: the words of a theme stand once in the plan of a link's tags, status and points, and a title is brought to its words once for noise."""
    from callscope.operators import lexicon as L

    plan = scoring.classified(F.col("t"), F.col("u"))._jc.toString()
    assert plan.count("(?=[c])") == 1 == plan.count("retificad|errata")  # the words of cotutela, and a status's
    once = text.normalise_words(F.col("t"))._jc.toString().count("regexp_replace")
    assert text.noise(F.col("t"), L.NOISE)._jc.toString().count("regexp_replace") == once
    rows = spark.createDataFrame([("Joint research on cotutela", None), ("Mapa do site aqui", "https://x.org/cotutela"), (None, "https://x.org/errata-cotutela-2026.pdf"), ("Nothing of note here", ""), (None, None)], "t string, u string")
    found = [r.c and (r.c.tags, r.c.status, r.c.points) for r in rows.select(scoring.classified(F.col("t"), F.col("u")).alias("c")).collect()]
    assert found == [(["cotutela", "pesquisa"], "aberto", 20), None, (["cotutela"], "retificacao", 11), None, None]


def test_merged_themes_reads_its_tags_once(spark):
    """tags are worked out once for all themes."""
    merged = scoring.merged_themes(scoring.text_tags(F.col("t")), F.col("s"))
    assert merged._jc.toString().count("array_union") == 1 == merged._jc.toString().count("transform(array(array_union")
    rows = spark.createDataFrame([("grant for joint research", ["internacional", "unknown"]), (None, [])], "t string, s array<string>")
    assert [r.m for r in rows.select(merged.alias("m")).collect()] == [["internacional", "pesquisa", "bolsas"], []]


def test_next_labels_are_brought_to_words_once(spark):
    """so is a pager link's label, whose rules read it twice."""
    once = text.normalise_words(F.col("t"))._jc.toString().count("regexp_replace")
    assert text.is_next_label(F.col("t"))._jc.toString().count("regexp_replace") == once
    for label, leads in (("Próxima página", True), ("»", True), ("Última próxima", False), ("uma chamada", False), (None, None)):
        assert one(spark, label, text.is_next_label(F.col("x"))) is leads


def test_calls_are_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    """F15, F16, F20, F21: tasks of text rules grow in number with their table, not in length, also where one file has one row group."""
    from callscope.sources import fixtures

    spark.range(20_000).selectExpr("id", "uuid() AS x").coalesce(1).write.parquet(f"file://{tmp_path}/t")
    rows = spark.read.parquet(f"file://{tmp_path}/t")
    assert fixtures.by_rows(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixtures, "SHARE", 1 << 15)
    sizes = fixtures.by_rows(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 3 * 20_000 / len(sizes) and sum(r["count"] for r in sizes) == 20_000


def test_dates_stand_where_they_are(spark):
    """dates are found without compiling a pattern for each text, at the places at which they stand."""
    assert "split(" not in dates.ALL_DATES
    value = "de 123/4/2027, 3/4/2027 e 03/04/2027; 2027-04-05 ou 12027-04-05. 5 de marco de 2027\u0001 march 9th, 2027 123 de maio 2027"
    rows = dates.with_dates(spark.createDataFrame([(value,)], "x string"), "x").first().dates
    assert [(value[d.start : d.end], d.day.isoformat()) for d in rows] == [("3/4/2027", "2027-04-03"), ("03/04/2027", "2027-04-03"), ("2027-04-05", "2027-04-05"), ("5 de marco de 2027", "2027-03-05"), ("march 9th, 2027", "2027-03-09")]


def test_accents_are_looked_up_once_a_text(spark):
    """The table of characters stands once in the expression: each further time is one more pass over the text."""
    assert str(text.strip_accents(F.col("x"))).count("translate(") == 1
    assert one(spark, "É ﬁm … 한국 ½ ﬁm", text.strip_accents(F.col("x"))) == "E fim ... 한국 1⁄2 fim"
    assert one(spark, None, text.strip_accents(F.col("x"))) is None and one(spark, None, text.normalise(F.col("x"))) == ""
