"""The search index against a scan, run by run."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from callscope.operators import search
from callscope.sources import storage

ROWS = {
    1: "Chamada de Cooperação Internacional", 2: "chamada nº 5: ½ bolsa", 3: "", 4: "ab", 5: "aaaaaa", 6: "Θέση μεταδιδάκτορα", 7: "a.c* [x] (cooperacao)",
    8: "x" * 50_000 + " agulha", 9: "😀 emoji 😀😀", 10: "abc abd", 11: "bcd abc", 12: "abd bcd cab", 13: "duas\nlinhas", 14: None,
}
SEARCHES = ["COOPERACAO", "ção", "ab", "a", "", "   ", "aaa", "aaaaaaa", "abcd", "bcd", "abc abd", "agulha", "Θεση", "😀😀", "c* [", "s\nl", "nunca visto", "xxxxxxxxxxxx", "1⁄2"]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def scan(rows, asked):
    return {k for k, t in rows.items() if t is not None and plain(asked.strip()) in plain(t)}


def found(spark, root, asked):
    keys = [r.key for r in search.search(spark, root, asked).collect()]
    assert len(keys) == len(set(keys))
    return set(keys)


def table(spark, rows):
    return spark.createDataFrame([(k, t) for k, t in rows.items()], "id long, t string")


def test_equals_a_scan_after_every_run(spark, tmp_path):
    root, live = f"file://{tmp_path}/index", {}
    with pytest.raises(FileNotFoundError):
        search.search(spark, root, "x")
    # A second run replaces rows, takes some out and adds one; a third adds nothing.
    for run in (ROWS, {1: "Edital sem a palavra", 5: None, 10: "abcd", 15: "nova cooperação", None: "cooperação sem chave"}, {}):
        search.extend(table(spark, run), root, "id", "t")
        live |= {k: t for k, t in run.items() if k is not None}
        for asked in SEARCHES if len(run) else ("cooperacao", "abcd"):
            assert found(spark, root, asked) == scan(live, asked), asked
    before = storage.latest(spark, root)[1]["runs"]
    search.compact(spark, root)
    assert len(before) == 3 and len(storage.latest(spark, root)[1]["runs"]) == 1
    for asked in ("cooperacao", "abcd", "ab", "aaa"):
        assert found(spark, root, asked) == scan(live, asked), asked


def test_repeated_keys_and_empty_runs(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    search.extend(table(spark, {}), root, "id", "t")
    assert found(spark, root, "abc") == found(spark, root, "") == set()
    rows = spark.createDataFrame([(1, "abc"), (1, "xyz"), (1, "abc"), (2, "abc"), (2, None)], "id long, t string")
    search.extend(rows, root, "id", "t")
    assert found(spark, root, "abc") == {2} and found(spark, root, "xyz") == {1}


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    search.extend(table(spark, {1: "primeira"}), root, "id", "t")
    with monkeypatch.context() as m:
        m.setattr(storage, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            search.extend(table(spark, {1: "segunda", 2: "primeira"}), root, "id", "t")
    assert found(spark, root, "primeira") == {1} and found(spark, root, "segunda") == set()


def test_grams(spark):
    texts = [None, "", "ab", "abc", "abab", "aaaa", "a😀bc"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(search.grams(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in got] == [[], [], [], ["abc"], ["aba", "bab"], ["aaa"], ["a😀b", "😀bc"]]


def test_all_eight_fields_are_searched(spark):
    row = spark.sql("""SELECT 'titulo' AS title, 'fonte' AS source, CAST(NULL AS STRING) AS region, 'motivo' AS why, array('eixo', 'outro') AS axes,
      array('tema') AS themes, array(named_struct('programme', 'prog', 'requires', 'exige', 'impact', 'bloqueia')) AS restrictions, array('docentes') AS audience""")
    text = row.select(search.searched_text(*map(F.col, ("title", "source", "region", "why", "axes", "themes", "restrictions", "audience")))).first()[0]
    assert text == "titulo fonte motivo eixo outro tema prog exige docentes"


def test_parts_that_hold_no_candidate_are_pruned(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    search.extend(spark.range(2000).select("id", F.concat(F.lit("linha numero "), F.md5(F.col("id").cast("string"))).alias("t")), root, "id", "t")
    hits = search.search(spark, root, "numero " + spark.sql("SELECT md5('77')").first()[0])
    assert [r.key for r in hits.collect()] == [77]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "In(gram" in plan


def test_alike_texts_share_their_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PARTS", 4)
    monkeypatch.setattr(search, "BLOCKS", 8, raising=False)
    root, n = f"file://{tmp_path}/index", 4000
    live = {i: f"Chamada de cooperacao internacional com bolsas de mobilidade numero {i}" for i in range(n)}
    changed = {i: None if i % 2 else f"edital {i}" for i in range(0, n, 7)}
    for run in (live, changed):
        search.extend(table(spark, run), root, "id", "t")
    live |= changed
    for asked in ("numero 77", "numero 777", "edital 14", "bolsas", "1 edital"):
        assert found(spark, root, asked) == scan(live, asked), asked
    kinds = [p for p in (tmp_path / "index").iterdir() if p.name not in ("texts", "counts", "commits")]
    # A text has some sixty grams.
    assert sum(spark.read.parquet(f"file://{p}").count() for p in kinds) < 10 * n
