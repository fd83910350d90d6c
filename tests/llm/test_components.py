"""Connected components, tables that go, and stages of empty tables."""

import os
import random

from callscope.llm import common, components, mixing, pii, quality, simhash


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "materialise", lambda df, label, f=components.materialise: made.append(label) or f(df, label))
    found = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(401)}
    assert made.count("edges") <= 10


def test_components_by_loop(spark):
    r = random.Random(1)
    edges = [tuple(r.sample(range(200), 2)) for _ in range(140)] + [(5, 5), (7, 8), (8, 7)]
    own = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in own:
        for a, b in edges:
            if a != b:
                own[a] = own[b] = min(own[a], own[b])
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == own
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_discarded_tables_go_and_kept_ones_stay(spark):
    place = lambda df: df.path_of_table.removeprefix("file://")
    with common.discarding(spark) as keep:
        with common.discarding(spark) as keep_inner:
            inner, lost = common.materialise(spark.range(3), "inner"), common.materialise(spark.range(2), "lost")
            keep_inner(inner)
        assert os.path.exists(place(inner)) and not os.path.exists(place(lost))
        outer = keep(common.materialise(inner, "outer"))
    assert outer.count() == 3 and not os.path.exists(place(inner))


def test_stages_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for stage in (simhash.keep_one, pii.sanitise, mixing.mixed_rows, lambda d: quality.keep_good(d, labels)):
        assert stage(empty).count() == 0 and stage(empty).columns == empty.columns
