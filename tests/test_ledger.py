"""The bucketed history: equal to the whole one, rewritten in proportion, resumed after a failure."""

import pytest

from callscope.operators import history as H
from callscope.operators import ledger
from callscope.sources import storage

ROWS = "key long, title string, status string, source string, position long"


def batch(spark, keys, status="aberto", year=2025):
    return spark.createDataFrame([(k, f"Chamada {k % 5} apoio {'mares' if k % 2 else 'clima'} {year}", status, f"s{k % 3}", i) for i, k in enumerate(keys)], ROWS)


def content(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


def test_equal_to_the_whole_history(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    whole = spark.createDataFrame([], H.SCHEMA)
    one = spark.createDataFrame([("s1",), ("s2",)], "source string")
    for run, (rows, ok) in enumerate([(batch(spark, range(40)), None), (batch(spark, range(20, 50), "encerrado", 2026), one), (batch(spark, [7, 7, 99], "futuro", 2027), None), (batch(spark, []), one)], 1):
        whole = storage.kept(H.upsert(whole, rows, run, ok), "whole")
        ledger.record(spark, root, rows, run, ok, buckets=8)
        assert content(ledger.read(spark, root)) == content(whole)


def test_a_small_run_rewrites_few_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    before = ledger.record(spark, root, batch(spark, range(1000)), 1, buckets=32)["paths"]
    none = spark.createDataFrame([], "source string")
    after = ledger.record(spark, root, batch(spark, range(0, 1000, 300), "encerrado"), 2, none)["paths"]
    changed = [b for b in after if after[b] != before[b]]
    assert 0 < len(changed) <= 4 and len(before) == 32
    assert ledger.record(spark, root, batch(spark, []), 3, none)["paths"] == after


def test_resumes_with_the_sources_that_are_left(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/ledger"
    parts = lambda: [(s, batch(spark, [k for k in range(12) if f"s{k % 3}" == s])) for s in ("s0", "s1", "s2")]
    real, calls = storage.commit, []

    def failing(*a):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("stopped")
        return real(*a)

    monkeypatch.setattr(storage, "commit", failing)
    with pytest.raises(OSError):
        ledger.record_by_source(spark, root, parts(), 1, 4)
    assert ledger.read(spark, root).count() == 4
    assert ledger.record_by_source(spark, root, parts(), 1, 4) == ["s1", "s2"]
    assert ledger.read(spark, root).count() == 12 and ledger.record_by_source(spark, root, parts(), 1, 4) == []
    assert ledger.record_by_source(spark, root, [("s0", batch(spark, []))], 2, 4) == ["s0"]
    assert ledger.read(spark, root).filter("status = 'verificar'").count() == 4
