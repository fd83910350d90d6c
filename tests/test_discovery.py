"""The search for replacement pages."""

from callscope.operators import discovery

PAGES = [
    ("https://h.org/", "<a href='/editais/#x'>Ver</a><a href='/editais'>Editais abertos</a><a href='https://o.org/editais'>Editais</a><a href='/chamadas/'>x</a><a href='/login/editais'>Editais</a><a href='/bolsas'>Bolsas</a><a href='#e'>Editais</a><a href='/contato'>Contato</a>"),
    ("https://h.org/editais/", "<a href='/a'>Chamada de mobilidade acadêmica 1</a><a href='/b'>Chamada de mobilidade acadêmica 2</a><a href='/b#2'>Mapa do site</a><a href='https://o.org/c'>Chamada de mobilidade acadêmica 3</a>"),
    ("https://h.org/editais", "<a href='/a'>Chamada de mobilidade acadêmica 1</a>"),
    ("https://h.org/chamadas", "<p>nada</p>"),
]


def test_replacements(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    homes = spark.createDataFrame([("s", "https://h.org"), ("none", "https://gone.org/")], "source string, url string")
    links = {r.url: (r.label, r.score, r.place) for r in discovery.promising_links(homes, pages).collect()}
    assert list(links) and set(links) == {"https://h.org/editais", "https://h.org/chamadas", "https://h.org/bolsas"}
    assert links["https://h.org/editais"][0] == "Ver" and links["https://h.org/editais"][2] == 1
    got = {r.url: (r.n_calls, r.place) for r in discovery.replacements(homes, pages).collect()}
    # Of two pages of one address the one with the lesser url counts; /bolsas does not answer.
    assert got == {"https://h.org/editais": (1, 1), "https://h.org/chamadas": (0, None)}
    assert [r.url for r in discovery.replacements(homes, pages, opened=1).collect()] == ["https://h.org/editais"]


def test_replacements_of_nothing(spark):
    none = spark.createDataFrame([], "url string, html string")
    assert discovery.replacements(spark.createDataFrame([], "source string, url string"), none).count() == 0


def test_of_equal_urls_the_first_page_counts(spark):
    listed = "".join(f"<a href='/{i}'>Chamada de mobilidade acadêmica {i}</a>" for i in range(3))
    pages = [(9, "https://h.org/editais", "<p>nada</p>"), (2, "https://h.org/editais", listed), (5, "https://h.org/editais", "<p>a</p>"), (None, "https://h.org/", "<a href='/editais'>Editais abertos</a>")]
    homes = spark.createDataFrame([("s", "https://h.org")], "source string, url string")
    for order in (pages, pages[::-1]):
        frame = spark.createDataFrame(order, "page_id long, url string, html string").coalesce(1)
        assert [r.n_calls for r in discovery.replacements(homes, frame).collect()] == [3]
