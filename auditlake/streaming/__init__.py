"""Incremental runs: findings and events as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.schema import fingerprint


def findings_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """New parquet files of findings in a folder, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def new_once(stream: DataFrame, time_col: str = "received_at", late: str = "30 days") -> DataFrame:
    """Each fingerprint and line once within the watermark; later copies and rows that come too late are dropped, and so is their state."""
    marked = stream.withColumn("fingerprint", fingerprint())
    return marked.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["fingerprint", "line"])


def windowed_counts(stream: DataFrame, time_col: str, *by: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts per window (tumbling, or sliding with ``slide``) and group; rows behind the watermark count no more."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return stream.withWatermark(time_col, late).groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: first and last time and number of rows, closed by a gap."""
    return stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def _trend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "score"])
    out = []
    for at, score in zip(rows["at"], rows["score"], strict=True):
        out.append({"project": key[0], "at": at, "score": int(score), "delta": None if last is None else int(score) - last})
        last = int(score)
    state.update((last,))
    yield pd.DataFrame(out, columns=["project", "at", "score", "delta"]).astype({"delta": "Int64"})


def score_trend(stream: DataFrame) -> DataFrame:
    """Each score of a project with the change to the one before it, kept as state: (project, at, score) in, delta added."""
    rows = stream.select("project", "at", F.col("score").cast("long").alias("score"))
    return rows.groupBy("project").applyInPandasWithState(_trend, "project string, at timestamp, score long, delta long", "last long", "append", GroupStateTimeout.NoTimeout)


def per_batch(stream: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch query over what arrived and appends its rows; ``availableNow`` ends when nothing is left.

    The batch number names the folder, so a batch that runs again after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
