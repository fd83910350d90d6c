"""The history as a stream's sink: each micro-batch is one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.operators import history as H
from callscope.sources import storage


def follow(stream: DataFrame, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Upsert each micro-batch of (key, title, status, source) into the committed state at ``root``.

    A commit notes its batch's number, so a batch that is run again after a failure finds
    its own commit, or makes it from the state before. The state's first batch may have
    any number; runs are counted by commits.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        number, says = storage.latest(spark, root)
        if says.get("epoch") == epoch:
            return
        before = storage.read_current(spark, root) if number else spark.createDataFrame([], H.SCHEMA)
        if "position" not in batch.columns:
            # Rows of one micro-batch have no order of their own: the greatest title, then status, is the last.
            order = Window.partitionBy("key").orderBy("title", "status")
            batch = batch.withColumn("position", F.row_number().over(order))
        storage.swap_in(H.upsert(before, batch, number + 1), root, str(epoch), number, epoch=epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(options or {"availableNow": True})).start()
