"""Every query of the engine against its oracle on the smallest tables."""

import oracle
import pytest

from callscope.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, name):
    assert oracle.difference(spark, name, SF, catalog.QUERIES, catalog.ORACLE_SQL) == ""


def test_of_lines_of_one_position_the_first_read_counts(spark, tmp_path):
    import random

    import pandas as pd

    r = random.Random(4)
    rows = [(key, line, part) for key in range(300) for line, part in ((1, 1_000_005), (2, 5), (1, 3))]
    r.shuffle(rows)
    pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey"]).to_parquet(tmp_path / "lineitem.parquet")
    assert oracle.difference(spark, "history_repeats", str(tmp_path), catalog.QUERIES, catalog.ORACLE_SQL) == ""


def test_of_pages_of_one_url_the_first_read_counts(spark, tmp_path):
    import pandas as pd

    # Page ids descend, so that the page read first is not the one of the least id; 121 and 111 have one url, 113 and 103 another.
    ids = [123, 121, 113, 111, 103, 101]
    urls = {121: "https://h.org/en/7", 111: "https://h.org/en/7", 113: "https://h.org/en/8", 103: "https://h.org/en/8"}
    rows = [(i, urls.get(i, f"https://h.org/en/x{i}"), "<p>nada</p>" + "<a href='/e/chamada-de-mobilidade'>Chamada de mobilidade</a>" * (i in (121, 103))) for i in ids]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert oracle.difference(spark, "replacement_pages", str(tmp_path), catalog.QUERIES, catalog.ORACLE_SQL) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_clusters_equal_greedy_leaders(spark):
    from callscope.functions.text import signature_tokens, year_of
    from callscope.operators import entity
    from pyspark.sql import functions as F

    rows = catalog._first_lines(spark, SF)
    marked = rows.select("position", signature_tokens(F.col("title")).alias("t"), year_of(F.col("title")).alias("y")).toPandas().sort_values("position")
    leaders, want = [], {}
    for p, t, y in marked.itertuples(index=False):
        t, y = set(t), None if y is None or y != y else int(y)
        fit = next((q for q, u, z in leaders if t and z == y and len(t & u) / len(t | u) >= 0.72), None) if t else None
        want[p] = p if fit is None else fit
        if fit is None and t:
            leaders.append((p, t, y))
    got = {r.position: r.leader for r in entity.leader_clusters(rows, "title", "position", 0.72).collect()}
    assert got == want
