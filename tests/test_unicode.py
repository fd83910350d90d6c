"""The normalisers against Python's Unicode tables."""

import unicodedata

from pyspark.sql import functions as F

from callscope.functions import text as T


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def test_every_assigned_character_below_20000(spark):
    codes = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rows = [(c, f"a{chr(c)}b{chr(c)}") for c in codes]
    frame = spark.createDataFrame(rows, "code long, x string").repartition(8)
    got = {r.code: r.y for r in frame.select("code", T.strip_accents(F.col("x")).alias("y")).collect()}
    wrong = [(hex(c), got[c]) for c, x in rows if got[c] != plain(x)]
    assert not wrong, (len(wrong), wrong[:10])


def test_texts_of_many_scripts(spark):
    texts = ["№ 5", "Θέση", "Йошкар-Ола", "Ｅｄｉｔａｌ", "…", "½", "①", "각 한글 가", "ﬁne ﬃ", "Ação º ª", "㌀ 𝐀𝑏", "ẹ́", "", "plain", "かゞ", "‼ﷺ"]
    frame = spark.createDataFrame([(x,) for x in texts] + [(None,)], "x string")
    assert [r.y for r in frame.select(T.strip_accents(F.col("x")).alias("y")).collect()] == [*map(plain, texts), None]
    assert [r.y for r in frame.select(T.normalise(F.col("x")).alias("y")).limit(5).collect()] == ["no 5", "θεση", "иошкар-ола", "edital", "..."]
