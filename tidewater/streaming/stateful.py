"""Streams with keyed state: duplicate suppression, rate limits, sessions, incremental ingestion, outbox.

Each has a batch form in operators/; over input in order both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as they come: the polled trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def suppress_duplicates(rows: DataFrame, keys: list[str], time: str, gap: str = "24 hours") -> DataFrame:
    """Rows that come at least the gap after the last kept row of their key; state expires with the gap.

    rows need a watermark on the time column.
    """
    width = pd.Timedelta(gap).value // 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(parts)).sort_values(time, kind="stable")
        last = state.get[0] if state.exists else None
        kept = []
        for i, t in enumerate(frame[time].astype("datetime64[us]").astype("int64") // 1_000):
            if last is None or t - last >= width:
                last = int(t)
                kept.append(i)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + width, state.getCurrentWatermarkMs() + 1))
        yield frame.iloc[kept]

    return rows.groupBy(*keys).applyInPandasWithState(run, rows.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit(rows: DataFrame, keys: list[str], time: str, limit: int, window: str = "60 seconds") -> DataFrame:
    """rows and accepted: at most `limit` rows in a window that opens with a key's first row; rejected rows count."""
    width = pd.Timedelta(window).value // 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(parts)).sort_values(time, kind="stable")
        at, n = state.get if state.exists else (None, 0)
        ok = []
        for t in frame[time].astype("datetime64[us]").astype("int64") // 1_000:
            at, n = (int(t), 1) if at is None or t - at >= width else (at, n + 1)
            ok.append(n <= limit)
        state.update((at, n))
        state.setTimeoutTimestamp(max(at + width, state.getCurrentWatermarkMs() + 1))
        yield frame.assign(accepted=ok)

    from pyspark.sql.types import BooleanType, StructType

    return rows.groupBy(*keys).applyInPandasWithState(run, StructType([*rows.schema.fields]).add("accepted", BooleanType()), "at long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(turns: DataFrame) -> DataFrame:
    """(channel, session_id, turns, last_role): state by key, without expiry."""
    return turns.groupBy("channel", "session_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"))


def windowed_counts(rows: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Beyond the batch rules: counts by event-time window, closed by a watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def ingest(rows: DataFrame, store: str, checkpoint: str, keys: list[str], digest: str = "hash") -> StreamingQuery:
    """Appends rows whose digest isn't the store's latest for their keys; runs over what there is and ends."""

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), "arrived").alias("_r")).select(*keys, "_r.*")
        try:
            known = spark.read.parquet(store).where(F.col("batch") != n)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            last = known.groupBy(*keys).agg(F.max_by(digest, F.struct("batch", "arrived")).alias("_was"))
            newest = newest.join(last, keys, "left").where(~F.col("_was").eqNullSafe(F.col(digest))).drop("_was")
        # a batch that runs again replaces its own rows
        newest.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_outbox(events: DataFrame, sink: str, checkpoint: str, attempts: int = 5) -> StreamingQuery:
    """Writes due rows (pending or failed, with attempts left) once each."""
    due = events.where(F.col("status").isin("pending", "failed") & (F.col("attempts") < attempts))
    return due.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
