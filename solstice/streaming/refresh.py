"""Incremental refresh with Structured Streaming: gated landing-zone updates and running storm state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solstice.functions import grid
from solstice.operators import tracks
from solstice.sources import sinks


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def refresh(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    gates: sinks.Gates | None = None,
) -> list[tuple[int, str]]:
    """Process the files that arrived since the last run; returns the refused batches with the reason.

    Each batch is published on its own behind the gates; a refused batch is left out and the last
    good state stays current. Refused runs are kept and tried again at the next refresh, since the gates
    or what they compare with may have changed; corrected files arrive as new files. A batch that was
    already published before a restart is skipped.
    """
    spark = stream.sparkSession
    if gates is not None:
        sinks.retry_refused(spark, root, gates)
    refused: list[tuple[int, str]] = []

    def publish_batch(batch: DataFrame, epoch: int) -> None:
        done = sinks.pointer(batch.sparkSession, root)
        if done is not None and int(done.run_id) >= epoch:
            return
        made = batch if transform is None else transform(batch)
        try:
            sinks.publish(made, root, gates, run_id=f"{epoch:09d}", append=True)
        except sinks.GateFailed as failure:
            refused.append((epoch, str(failure)))
            sinks.keep_refused(spark, root, [*sinks.refused(spark, root), failure.path])

    query = stream.writeStream.foreachBatch(publish_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return refused


def storm_stream(fixes: DataFrame, out: str, checkpoint: str, delay: str = "30 days", span: str = "30 days") -> dict[str, int]:
    """Keep first fix and maximum wind per storm, and the distinct cells per storm, over an arriving feed.

    The state holds one row per storm and ``span`` of time, and drops it once the watermark has passed the span, so a storm
    leaves it ``delay`` after its last span ended; until then a late fix still counts. First fix and maximum wind of a storm
    come out of the spans written so far, whose parts add up in any order. Changed spans are appended per batch. The cells are
    rows, not a growing set in the state, and their duplicates are dropped within the watermark.

    Returns the rows left in the state of either stream.
    """
    marked = fixes.withWatermark("ts", delay)
    first = F.min(F.struct("ts", "fix_id", "basin", "lat", "lon")).alias("g")
    wind = F.max(tracks.wind("wmo_wind", "usa_wind")).alias("wind")
    running = marked.groupBy("sid", F.window("ts", span).alias("span")).agg(first, wind, F.max("ts").alias("last_ts"))

    def append(batch: DataFrame, epoch: int) -> None:
        # a batch that is tried again replaces what it wrote before
        batch.select("sid", "g", "wind", "last_ts").write.mode("overwrite").parquet(f"{out}/storms/batch={epoch:09d}")

    storms = running.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{checkpoint}/storms").trigger(availableNow=True).start()
    storms.awaitTermination()

    visited = marked.select("sid", "ts", grid.cell_id(F.col("lat"), F.col("lon"), "half_even").alias("cell_id"))
    cells = visited.dropDuplicatesWithinWatermark(["sid", "cell_id"]).select("sid", "cell_id")
    sink = cells.writeStream.outputMode("append").format("parquet").option("path", f"{out}/cells").option("checkpointLocation", f"{checkpoint}/cells").trigger(availableNow=True).start()
    sink.awaitTermination()
    return {"storms": _state_rows(storms), "cells": _state_rows(sink)}


def _state_rows(query: StreamingQuery) -> int:
    progress = query.lastProgress
    return sum(op["numRowsTotal"] for op in progress["stateOperators"]) if progress else 0


def _storms(spark: SparkSession, out: str) -> DataFrame:
    """First fix, maximum wind and last time per storm: the spans written so far, put together."""
    return spark.read.parquet(f"{out}/storms").groupBy("sid").agg(F.min("g").alias("g"), F.max("wind").alias("wind"), F.max("last_ts").alias("last_ts"))


def storm_state(spark: SparkSession, out: str) -> DataFrame:
    """State per storm so far, in the shape of ``tracks.storms``."""
    return _storms(spark, out).select("sid", "g.basin", F.col("g.lat").alias("glat"), F.col("g.lon").alias("glon"), F.coalesce("wind", F.lit(-1.0)).alias("max_wind"))


def ended_storms(spark: SparkSession, out: str, delay: str = "30 days") -> DataFrame:
    """``sid, last_ts`` of storms without a fix in the last ``delay`` of the feed; no fix that is still accepted belongs to their past."""
    rows = _storms(spark, out).select("sid", "last_ts")
    newest = rows.agg((F.max("last_ts") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    # one row on the right
    return rows.join(F.broadcast(newest), F.col("last_ts") < F.col("_mark")).select("sid", "last_ts")


def fold_storms(spark: SparkSession, out: str, to: str) -> None:
    """Write what is known as one row per storm to a new folder, for a feed that is carried on there."""
    _storms(spark, out).select("sid", "g", "wind", "last_ts").write.mode("errorifexists").parquet(f"{to}/storms/batch=folded")
    storm_cells(spark, out).write.mode("errorifexists").parquet(f"{to}/cells")


def storm_cells(spark: SparkSession, out: str) -> DataFrame:
    """Distinct cells per storm; repeats further apart than the watermark are removed here."""
    return spark.read.parquet(f"{out}/cells").distinct()
