"""The panel as files: numbered scripts of rows and an index page, published as one commit."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callscope.operators import panel
from callscope.sources import storage

#: Rows of one script.
ROWS = 20_000
_HEAD, _TAIL = "rows.push(", ");"
_PAGE = """<!doctype html>
<html lang="pt-BR"><meta charset="utf-8"><title>{title}</title>
<h1>{title}</h1>
<p>{counts}</p>
<table id="rows"></table>
<script>const rows = [], labels = {labels}, shown = {shown};</script>
{scripts}
<script>
const table = document.getElementById("rows");
for (const row of rows) {{
  const line = table.insertRow();
  for (const name of shown) line.insertCell().textContent = (labels[name] || {{}})[row[name]] || (row[name] ?? "");
}}
</script>
</html>
"""


def publish(rows: DataFrame, root: str, keys: list[Column], title: str, shown: list[str], rows_per_script: int = ROWS) -> int:
    """Write the rows in the order of ``keys`` as scripts beside an index page, then commit; returns the commit's number.

    Scripts are written by Spark's own committed writer and are numbered in the rows' order; the page
    names them and holds the counts and labels. A failed task or a failure before the commit leaves the
    published panel as it was; of two writers one gets ``Conflict``. Texts cannot end a script element. An empty
    table gives a page without scripts.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    number, _ = storage.latest(spark, root)
    rows, folder = storage.kept(rows, "panel"), f"{root}/panel-{uuid.uuid4().hex}"
    line = F.concat(F.lit(_HEAD), F.col("value"), F.lit(_TAIL)).alias("value")
    panel.panel_json(rows, keys).select(line).write.option("maxRecordsPerFile", rows_per_script).text(f"{folder}/scripts")
    names = storage.renumbered(spark, f"{folder}/scripts", ".js")
    counts = panel.kpis(rows).first().asDict()
    storage.put(spark, f"{folder}/index.html", _page(title, shown, counts, names))
    return storage.commit(spark, root, {"path": folder, "scripts": len(names), "counts": counts}, number)


def _page(title: str, shown: list[str], counts: dict, names: list[str]) -> str:
    safe = lambda value: json.dumps(value, ensure_ascii=False).replace("</", "<\\/")
    said = ", ".join(f"{name.removeprefix('n_')}: {n}" for name, n in counts.items())
    scripts = "\n".join(f'<script src="scripts/{name}"></script>' for name in names)
    return _PAGE.format(title=html.escape(title), counts=said, labels=safe(panel.LABELS), shown=safe(shown), scripts=scripts)


def published(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The rows of the newest published panel."""
    number, says = storage.latest(spark, root)
    if not number:
        raise FileNotFoundError(f"{root} has no panel")
    if not says["scripts"]:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(f"{says['path']}/scripts/*.js")
    body = F.substring("value", F.lit(len(_HEAD) + 1), F.length("value") - len(_HEAD) - len(_TAIL))
    return lines.select(F.from_json(body, schema).alias("row")).select("row.*")
