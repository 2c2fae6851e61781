"""Keyed streams in event order: rows that come late or out of order give what sorted input gives.

Each key has a list of rows that may still be overtaken. When the watermark has passed a row,
none before it can come any more (later ones would be dropped as late), and a timer releases
all such rows in order into a fold: a value that goes from row to row. So results don't depend
on how rows are spread over micro-batches, or sorted in them.

State is a key's rows within the watermark's delay, its fold and one timer. A fold says until
when it matters; once the watermark is past that and no row waits, the key's state is cleared.
The state store must be able to hold lists and timers (see use_state_store()).

Nulls and edge cases: rows without a time are never released and are dropped; rows of equal
time are taken in the order of the tie columns, nulls first; rows that come after the watermark
are dropped by the stream; a null key is a key; repeated rows are rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that start in this session keep their state in RocksDB, which lists, maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Fold(Protocol):
    """What goes from row to row of a key."""

    #: Fields of the value, all long.
    state: tuple[str, ...]

    def step(self, value: tuple | None, at: int) -> tuple[tuple, Any]:
        """The value after a row of time `at` (microseconds), and what is said of the row; None leaves it out."""

    def until(self, value: tuple) -> int:
        """The time from which the value no longer matters."""


class KeptAfterGap:
    """Rows that come at least the gap after the last kept one; the rest are duplicates."""

    state = ("last",)

    def __init__(self, gap: str) -> None:
        self.gap = pd.Timedelta(gap).value // 1_000

    def step(self, value: tuple | None, at: int) -> tuple[tuple, bool | None]:
        return ((at,), True) if value is None or at - value[0] >= self.gap else (value, None)

    def until(self, value: tuple) -> int:
        return value[0] + self.gap


class WindowLimit:
    """True for the first rows, up to the limit, of a window that a key's first row opens."""

    state = ("start", "n")

    def __init__(self, width: str, limit: int) -> None:
        self.width, self.limit = pd.Timedelta(width).value // 1_000, limit

    def step(self, value: tuple | None, at: int) -> tuple[tuple, bool]:
        start, n = (at, 1) if value is None or at - value[0] >= self.width else (value[0], value[1] + 1)
        return (start, n), n <= self.limit

    def until(self, value: tuple) -> int:
        return value[0] + self.width


class InOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, and go through the fold in order."""

    def __init__(self, rows: StructType, fold: Fold, said: str | None) -> None:
        self.rows, self.fold, self.said = rows, fold, said

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.value = handle.getValueState("value", StructType([StructField(c, LongType()) for c in self.fold.state]))
        self.timer = handle.getValueState("timer", "at long")

    def _ring(self, at: int) -> None:
        """One timer a key: it rings once the watermark has reached `at`."""
        was = self.timer.get()[0] if self.timer.exists() else None
        ms = -(-at // 1_000) - 1  # timers ring when the watermark is past them
        if was != ms:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [tuple(r) for r in rows if r["_at"] is not None]
        if new:
            first = min(r[-1] for r in new)
            self.waiting.appendList(new)
            was = self.timer.get()[0] if self.timer.exists() else None
            # a timer for rows that wait already rings first, or this one does
            if was is None or -(-first // 1_000) - 1 < was:
                self._ring(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        self.timer.clear()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[-1] <= passed), key=lambda r: (r[-1], *((v is not None, v) for v in r[-2])))
        rest = [r for r in held if r[-1] > passed]
        value = tuple(self.value.get()) if self.value.exists() else None
        made = Row(*self.rows.names[:-2], *([self.said] if self.said else []))
        for r in due:
            value, told = self.fold.step(value, r[-1])
            if told is not None:
                yield made(*r[:-2], *([told] if self.said else []))
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if rest:
            self._ring(min(r[-1] for r in rest))
        elif value is not None and self.fold.until(value) > passed:
            self._ring(self.fold.until(value))
        if value is not None and (rest or self.fold.until(value) > passed):
            self.value.update(value)
        else:
            self.value.clear()

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], time: str, fold: Fold, said: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows, which need a watermark on the column `time`, as their fold keeps them; said names a boolean column for what it tells."""
    use_state_store(rows.sparkSession)
    tie = F.array(*[F.col(c).cast("string") for c in ties]).cast("array<string>")
    put = rows.select("*", tie.alias("_tie"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    out = StructType([*rows.schema.fields, *([StructField(said, BooleanType())] if said else [])])
    return put.groupBy(*keys).transformWithState(InOrder(put.schema, fold, said), out, "append", "eventtime")


def suppress_duplicates(rows: DataFrame, keys: list[str], time: str, gap: str = "24 hours", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows that come at least the gap after the last kept row of their key, in event order."""
    return in_order(rows, keys, time, KeptAfterGap(gap), ties=ties)


def rate_limit(rows: DataFrame, keys: list[str], time: str, limit: int, window: str = "60 seconds", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows and accepted: at most `limit` in a window that opens with a key's first row, in event order; rejected rows count."""
    return in_order(rows, keys, time, WindowLimit(window, limit), "accepted", ties)


TURN = "channel string, session_id string, turn long, role string, text string, customer_id string, metadata map<string,string>"
SESSION = StructType([
    StructField("channel", StringType()), StructField("session_id", StringType()), StructField("customer_id", StringType()), StructField("metadata", MapType(StringType(), StringType())),
    StructField("transcript", ArrayType(StructType([StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())]))),
])


class Sessions(StatefulProcessor):
    """State by (channel, session_id), without expiry: turns in a list, metadata in a map, the customer in a value."""

    def __init__(self, recent: int) -> None:
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string, seen long")
        self.metadata = handle.getMapState("metadata", "name string", "value string, turn long, seen long")
        self.customer = handle.getValueState("customer", "id string, turn long, seen long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        said, names, who = [], {}, tuple(self.customer.get()) if self.customer.exists() else None
        later = lambda turn, seen, than: than is None or (turn, seen) >= (than[-2], than[-1])
        for r in rows:
            turn = -1 if r.turn is None else r.turn
            if r.role is not None:
                said.append((r.turn, r.role, r.text, n))
            if r.customer_id is not None and later(turn, n, who):
                who = (r.customer_id, turn, n)
            for name, value in dict(r.metadata or {}).items():
                if later(turn, n, names.get(name)):
                    names[name] = (value, turn, n)
            n += 1
        if said:
            self.turns.appendList(said)
        for name, new in names.items():
            held = self.metadata.getValue((name,)) if self.metadata.containsKey((name,)) else None
            if later(new[1], new[2], tuple(held) if held else None):
                self.metadata.updateValue((name,), new)
        if who is not None:
            self.customer.update(who)
        self.count.update((n,))
        # nulls first; of equal turns the one that came first
        held = sorted((tuple(t) for t in self.turns.get()), key=lambda t: (t[0] is not None, t[0] or 0, t[3]))
        whole = {k[0]: v[0] for k, v in self.metadata.iterator()}
        yield Row(*SESSION.names)(*key, who[0] if who else None, whole, [Row("turn", "role", "text")(*t[:3]) for t in (held[-self.recent :] if self.recent else held)])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, recent: int = 0) -> DataFrame:
    """(channel, session_id, customer_id, metadata, transcript) of each session that a micro-batch touches.

    turns have the columns of TURN; a row without a role only brings metadata. The transcript
    is in the order of turns; metadata are merged key by key, the later turn's winning, and
    null values count; a customer once known stays until another is named. recent, if it isn't
    0, bounds the transcript of the output to so many last turns; all are kept.
    """
    use_state_store(turns.sparkSession)
    return turns.groupBy("channel", "session_id").transformWithState(Sessions(recent), SESSION, "update", "none")


def sessions_of(turns: DataFrame) -> DataFrame:
    """The batch form of sessions(): all turns at once."""
    at = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.monotonically_increasing_id().alias("seen"))
    rows = turns.select("*", at.alias("_at"))
    keys = ["channel", "session_id"]
    named = rows.select(*keys, "_at", F.explode("metadata").alias("name", "value")).groupBy(*keys, "name").agg(F.max_by(F.struct("value"), "_at").alias("v"))
    named = named.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "v.value"))).alias("metadata"))
    turn = F.struct("turn", "role", "text")
    held = rows.groupBy(*keys).agg(
        F.max_by("customer_id", F.when(F.col("customer_id").isNotNull(), F.col("_at"))).alias("customer_id"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("_at", turn.alias("t"))))), lambda x: x["t"]).alias("transcript"),
    )
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    return held.alias("h").join(named.alias("n"), same[0] & same[1], "left").select(*[f"h.{c}" for c in keys], "customer_id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "transcript")


class Changed(StatefulProcessor):
    """Rows whose digest differs from the last one of their key, with their version."""

    def __init__(self, digest: str, order: str) -> None:
        self.digest, self.order = digest, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r[self.order] is not None, r[self.order]))
        was, version = tuple(self.last.get()) if self.last.exists() else (None, 0)
        if not version or was != newest[self.digest]:
            self.last.update((newest[self.digest], version + 1))
            yield Row(*newest.__fields__, "version")(*newest, version + 1)

    def close(self) -> None:
        pass


def changed(rows: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """rows and version: of each micro-batch the newest row of a key, unless its digest is the key's last.

    The last digest of each key is state, so that no stored row is read to know what is new;
    what comes out is appended.
    """
    use_state_store(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(Changed(digest, order), StructType([*rows.schema.fields, StructField("version", LongType())]), "append", "none")
