"""Rule tables as data against loops, with tables far larger than the built-in ones."""

import random

from pyspark.sql import functions as F

from callscope.functions import text as T
from callscope.operators import lexicon as L
from callscope.operators import scoring, terms

WORDS = ["coil", "recoil", "ação", "joint", "research", "joint research", "e", "", "a b", "über", "x_y", "co"]


def test_terms_by_loop(spark, monkeypatch):
    r = random.Random(1)
    texts = [None, "", "recoiling", *[" ".join(r.choices([*WORDS, "xcoily", "b", "researcher", "_joint"], k=r.randint(1, 12))) for _ in range(80)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = [(100 - i, w) for i, w in enumerate([*WORDS, "coil", None])]
    want = {i: sorted(k for k, w in table if w and w in (t or "")) for i, t in enumerate(texts)}
    frame = spark.createDataFrame(table, "term_id long, term string")
    for size in (terms.SLICE, 7):
        monkeypatch.setattr(terms, "SLICE", size)
        assert {x.id: list(x.term_ids) for x in terms.with_terms(rows, "text", frame).collect()} == want
    assert all(x.term_ids == [] for x in terms.with_terms(rows, "text", frame.limit(0)).collect())


def test_a_large_table_has_the_plan_of_a_small_one(spark):
    r = random.Random(2)
    many = tuple("".join(r.choices("abcdefgh", k=r.randint(5, 9))) for _ in range(10_000))
    texts = ["".join(r.choices("abcdefgh ", k=400)) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def profile(n):
        return L.Profile(tuple(L.Axis(f"k{i}", f"l{i}", r.randint(1, 9), many[i:n:7], ("t",)) for i in range(7)))

    small, large = profile(70), profile(10_000)
    plans = []
    for p in (small, large):
        found = rows.select("id", terms.axis_hits(F.col("text"), p).alias("axes"))
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        want = {i: [(a.key, tuple([x for x in a.terms if x in (t or "")][:5])) for a in p.ranked if any(x in (t or "") for x in a.terms)] for i, t in enumerate(texts)}
        assert {x.id: [(a.key, tuple(a.hits)) for a in x.axes] for x in found.collect()} == want
    assert abs(plans[0] - plans[1]) < 20


def test_automaton_equals_the_expressions(spark):
    r = random.Random(3)
    themes = (*L.THEMES, L.Theme("gaps", 2, ("co tutela", "a b c", "über x", "pesquisa", "")))
    pool = ["mobilidade", "academica", "internacional", "cotutela", "co", "tutelada", "a", "b", "bc", "c", "research", "joint", "xresearch", "pesquisador", "über", "x", "_a", "grants", "1a"]
    rows = spark.createDataFrame([(i, " ".join(r.choices(pool, k=r.randint(0, 9)))) for i in range(300)] + [(300, None)], "id long, text string")
    usable = tuple(L.Theme(t.key, t.priority, tuple(w for w in t.words if w)) for t in themes)
    both = rows.withColumn("w", T.normalise_words(F.col("text"))).select("id", terms.theme_tags(F.col("w"), themes).alias("one"), scoring.theme_tags(F.col("w"), usable).alias("other"), terms.axis_hits(F.col("w"), L.PROFILE).alias("hits"), scoring.axis_hits(F.col("w"), L.PROFILE).alias("native")).collect()
    assert all(list(x.one) == list(x.other) and x.hits == x.native for x in both) and any(x.one for x in both)


def test_texts_come_to_workers_in_bounded_batches(spark):
    """A batch is bounded by bytes, not by ten thousand texts of any length, and one Python function names the terms."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.createDataFrame([(1, "recoil " * 50)], "id long, text string")
    found = terms.with_terms(rows, "text", spark.createDataFrame([(7, "coil"), (3, "recoil")], "term_id long, term string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 23
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "named(" not in plan
    assert found.first().term_ids == [3, 7]


def test_every_word_of_the_benchmark_is_a_term(spark, tmp_path):
    import oracle
    import pandas as pd
    from callscope.plans import catalog

    pd.DataFrame([(1, "Ação de um e o lar"), (2, "e"), (3, ""), (4, None)], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame([(1, "um dia, lá"), (2, "xyz"), (3, "Acao"), (4, None), (5, "LAR")], columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    # acao 1, de 2, e 3, lar 4, o 5, um 6
    assert {r.doc_id: (r.n_terms, r.ids) for r in catalog.QUERIES["large_lexicon"](spark, str(tmp_path)).collect()} == {1: (1, 6), 3: (2, 6), 5: (1, 4)}
    assert oracle.difference(spark, "large_lexicon", str(tmp_path), catalog.QUERIES, catalog.ORACLE_SQL) == ""
