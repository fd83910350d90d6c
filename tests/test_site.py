"""The published panel: order, pages, read back whole, nothing from a failed task."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from callscope.sources import site, storage

SCHEMA = "id long, status string, priority double, days_left int, title string"


def rows(spark, n):
    title = F.concat(F.lit("é </script><script>alert(1)</script> \n \"q\" \\ {x}   "), F.col("id"))
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "aberto").alias("status"), F.lit(40.5).alias("priority"), F.when(F.col("id") % 3 > 0, 5).alias("days_left"), title.alias("title"))


def test_read_back_equals_the_rows(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    with pytest.raises(FileNotFoundError):
        site.published(spark, root, SCHEMA)
    assert site.publish(rows(spark, 25), root, [F.col("id")], "Editais <& mais", ["title", "status"], 4) == 1
    assert sorted(site.published(spark, root, SCHEMA).collect()) == sorted(rows(spark, 25).collect())
    says = storage.latest(spark, root)[1]
    folder = says["path"].removeprefix("file://")
    with open(f"{folder}/index.html", encoding="utf-8") as f:
        page = f.read()
    named = re.findall(r'<script src="scripts/(\d+\.js)"', page)
    assert len(named) == says["scripts"] >= 7 and named == sorted(named) and "<h1>Editais &lt;&amp; mais</h1>" in page
    assert "open: 13, recommended: 13, urgent: 8, check: 0, total: 25" in page
    ids = []
    for name in named:
        with open(f"{folder}/scripts/{name}", encoding="utf-8", newline="\n") as f:
            lines = f.read().removesuffix("\n").split("\n")
        assert len(lines) <= 4 and all("</" not in x for x in lines)
        ids += [int(re.match(r'rows\.push\(\{"id":(\d+),', x)[1]) for x in lines]
    assert ids == list(range(25)) and len(glob.glob(f"{folder}/scripts/*.js")) == len(named)


def test_a_failed_task_leaves_the_old_panel(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    site.publish(rows(spark, 3), root, [F.col("id")], "a", ["title"])
    broken = rows(spark, 9).withColumn("title", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        site.publish(broken, root, [F.col("id")], "b", ["title"])
    assert storage.latest(spark, root)[0] == 1 and site.published(spark, root, SCHEMA).count() == 3


def test_an_empty_panel(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    site.publish(rows(spark, 5), root, [F.col("id")], "a", ["title"])
    site.publish(rows(spark, 0), root, [F.col("id")], "a", ["title"])
    assert site.published(spark, root, SCHEMA).count() == 0
