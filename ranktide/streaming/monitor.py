"""Monitoring the measure over a stream of scored events.

Tie counts and target sums by window, segment and score are what the measure needs, and
they add up; the stream keeps those as its state, and each closed window is measured
in ``foreachBatch``.  Rows later than the watermark are dropped by Spark.  ``labelled`` joins labels that come later than their scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ranktide.functions.ranks import rank_sums
from ranktide.operators.measure import from_sums


def labelled(scores: DataFrame, labels: DataFrame, key: str, ts: str, label_ts: str, horizon: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The scores with the columns of their label, which may come up to ``horizon`` later than the score: a join of two streams, or of two tables.

    Rows wait in the state of the join until their label comes or the watermarks of both streams have passed the horizon; scores without a label
    until then are left out.  ``ts`` and ``label_ts`` are timestamps.
    """
    a, b = scores, labels.withColumnRenamed(key, "_label_key")
    if a.isStreaming:
        a, b = a.withWatermark(ts, late), b.withWatermark(label_ts, late)
    in_time = (F.col(label_ts) >= F.col(ts)) & (F.col(label_ts) <= F.col(ts) + F.expr(f"INTERVAL {horizon}"))
    return a.join(b, (F.col(key) == F.col("_label_key")) & in_time).drop("_label_key")


def tie_counts(events: DataFrame, ts: str, y: str, z: str, segments: Sequence[str] = (), window: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """start, segments, y, z, n for every tumbling window; works on a stream and on a table.  ``late`` is None for a stream that has a watermark already, such as ``labelled`` gives."""
    e = events.withColumnRenamed(ts, "_ts") if late is None else events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", late) if e.isStreaming and late else e
    g = e.groupBy(F.window("_ts", window).alias("_w"), *segments, F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z")).agg(F.count("*").alias("n"))
    return g.select(F.col("_w.start").alias("start"), *segments, "y", "z", "n")


def measured(ties: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """start, segments, n, rga from tie counts."""
    keys = ["start", *segments]
    sums = rank_sums(ties, keys, "y", ["z", "y"], weight="n").withColumn("_rows", F.col("_w"))  # a tie stands for n rows
    return sums.select(*keys, F.col("_rows").cast("bigint").alias("n"), from_sums()[0].alias("rga"))


def monitor(events: DataFrame, ts: str, y: str, z: str, path: str, checkpoint: str, segments: Sequence[str] = (), window: str = "1 day", late: str | None = "1 hour", **trigger) -> StreamingQuery:
    """Starts a query that appends each closed window's measure to Parquet at ``path``; a batch that is run again overwrites its own folder.

    Labels that come in a stream of their own: ``monitor(labelled(scores, labels, ...), ..., late=None)``.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read for the cuts and for the sums
        try:
            measured(batch, segments).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return tie_counts(events, ts, y, z, segments, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()
