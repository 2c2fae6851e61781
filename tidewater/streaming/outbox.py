"""An outbox with retries: attempts and payloads in keyed state, timers for the back-off.

Two streams meet by event id: new events, and outcomes of earlier attempts. The state machine
of an event says when the next attempt is due; a micro-batch's due attempts are made by the
executors and their outcomes written to a folder that is read back as the second stream:

    pending --due--> sent --ok--> delivered
                      |--error, attempts left--> waits backoff * 2^(attempts - 1) --> sent
                      |--error, no attempts left--> given up

Outcomes of a micro-batch lie in a folder with its number. A batch that runs again after a
crash finds them there and sends nothing, or, if it had not come to its end, writes them anew;
state goes back with the batch. So each outcome is recorded once. What was sent but not yet
recorded when an executor or the driver was lost is sent again, as in any outbox; (id, attempt)
tells the receiver.

Nulls and edge cases: events without an id are dropped; of events with equal id the first
counts, also after it has been delivered or given up, as long as `remember` says; a send that
raises fails its batch of rows, one outcome a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .ordered import use_state_store

ATTEMPTS = 5
EVENT = "id string, destination string, payload string"
DUE = "id string, destination string, payload string, attempt long"
OUTCOME = f"{DUE}, error string, at timestamp"

#: Takes due attempts (columns of DUE); gives an error for each, None where it went well.
Send = Callable[[pd.DataFrame], pd.Series]


class Retries(StatefulProcessor):
    """When the next attempt of an event is due."""

    def __init__(self, attempts: int, backoff_ms: int, remember_ms: int) -> None:
        self.attempts, self.backoff, self.remember = attempts, backoff_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "destination string, payload string, attempts long, next_due long")
        self.done = handle.getValueState("done", "attempts long, delivered boolean", self.remember)

    def _due(self, key: Any, destination: str, payload: str, attempt: int) -> Row:
        return Row("id", "destination", "payload", "attempt")(key[0], destination, payload, attempt)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.attempt or 0):
            if r.attempt is None:
                if not self.open.exists() and not self.done.exists():
                    self.open.update((r.destination, r.payload, 0, None))
                    yield self._due(key, r.destination, r.payload, 1)
            elif self.open.exists():
                destination, payload, attempts, _ = self.open.get()
                if r.attempt != attempts + 1:
                    continue  # known already
                if r.error is None or r.attempt >= self.attempts:
                    self.open.clear()
                    self.done.update((r.attempt, r.error is None))
                else:
                    at = timerValues.getCurrentProcessingTimeInMs() + self.backoff * 2 ** (r.attempt - 1)
                    self.open.update((destination, payload, r.attempt, at))
                    self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            destination, payload, attempts, due = self.open.get()
            if due is not None:
                self.open.update((destination, payload, attempts, None))
                yield self._due(key, destination, payload, attempts + 1)

    def close(self) -> None:
        pass


def _attempt(send: Send) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for due in parts:
            try:
                errors = list(send(due))
            except Exception as e:  # noqa: BLE001  what a receiver raises is the outcome
                errors = [str(e) or type(e).__name__] * len(due)
            yield due.assign(error=[None if pd.isna(e) else str(e)[:1000] for e in errors], at=pd.Timestamp.now("UTC").tz_localize(None))

    return run


def _recorded(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def deliver(events: DataFrame, send: Send, outcomes: str, checkpoint: str, attempts: int = ATTEMPTS, backoff: str = "30 seconds", every: str = "10 seconds", remember: str = "7 days") -> StreamingQuery:
    """Sends the events of a stream (columns of EVENT), with retries; outcomes (OUTCOME) are in the folder."""
    spark = events.sparkSession
    use_state_store(spark)
    ms = lambda gap: pd.Timedelta(gap).value // 1_000_000
    known = spark._jvm.org.apache.hadoop.fs.Path(outcomes)
    known.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(known)
    told = spark.readStream.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(outcomes)
    new = events.where("id is not null").select("id", "destination", "payload", F.lit(None).cast("long").alias("attempt"), F.lit(None).cast("string").alias("error"))
    both = new.union(told.select("id", "destination", "payload", "attempt", "error"))
    due = both.groupBy("id").transformWithState(Retries(attempts, ms(backoff), ms(remember)), DUE, "append", "processingtime")

    def put(batch: DataFrame, n: int) -> None:
        if not _recorded(batch.sparkSession, f"{outcomes}/{n}"):
            batch.mapInPandas(_attempt(send), OUTCOME).write.mode("overwrite").parquet(f"{outcomes}/{n}")

    return due.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def statuses(outcomes: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(id, destination, status, attempts, last_error, delivered_at) of all events that have been tried."""
    got = outcomes.groupBy("id").agg(F.max_by("destination", "attempt").alias("destination"), F.max("attempt").alias("attempts"), F.max_by("error", "attempt").alias("last_error"), F.min(F.when(F.col("error").isNull(), F.col("at"))).alias("delivered_at"))
    status = F.when(F.col("delivered_at").isNotNull(), "delivered").when(F.col("attempts") >= attempts, "given up").otherwise("failed")
    return got.select("id", "destination", status.alias("status"), "attempts", "last_error", "delivered_at")
