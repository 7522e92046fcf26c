"""Windows over event time, as batch or stream: the same plan runs in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..lake import Lake


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream's watermark; it needs times with a zone."""
    if late is None or not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, width: str, by: list[str] = (), late: str | None = None) -> DataFrame:
    """start, by..., n: events per window; ``late`` is the watermark of a stream."""
    events = _watermarked(events, time, late)
    return events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, time: str, width: str, step: str, by: list[str] = (), late: str | None = None) -> DataFrame:
    events = _watermarked(events, time, late)
    return events.groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """by..., start, end, n: runs of events with less than ``gap`` between them; end is the last event's time plus the gap."""
    events = _watermarked(events, time, late)
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest(stream: DataFrame, lake: Lake, table: str, checkpoint: str):
    """Append each micro-batch to a lake table as one commit; a batch that was committed is not added again."""

    def commit(batch: DataFrame, id: int) -> None:
        mark = f"stream:{table}:{id}"
        if mark in lake.log.acked():
            return
        base = lake.log.last()
        old = lake.log.state(table)
        files = [*(old["files"] if old else []), *lake.stage(batch, table, base + 1)]
        lake.commit({table: lake.entry(batch.schema, files, "append")}, {"stream": table, "batch": id}, [mark], base)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
