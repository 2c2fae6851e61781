"""Streams in event order, sessions and changes against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates as A
from tidewater.streaming import ordered as O
from tidewater.streaming import stateful as X


@pytest.fixture
def shuffled(spark, tmp_path):
    """Events of five clients over some days, one hot, out of order by up to two hours, in ten files."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 4 + ["a", "b", None]), i, rng.randint(0, 4 * 86_400)) for i in range(400)]
    rows += [("a", 1000 + k, 500) for k in range(5)]  # ties
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, 7_000))
    end = [("end", 9999, 40 * 86_400)]
    schema = "k string, i int, s long"
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("s"))).alias("ts")
    for n in range(10):
        part = late[n * len(late) // 10 : (n + 1) * len(late) // 10]
        part = rng.sample(part, len(part)) + (end if n == 9 else [])
        spark.createDataFrame(part, schema).select("k", "i", at).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    batch = spark.createDataFrame(rows, schema).select("k", "i", at)
    stream = spark.readStream.schema("k string, i int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return batch, stream.withWatermark("ts", "3 hours")


def run(stream, name, path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_limits_in_event_order(spark, shuffled, tmp_path):
    batch, stream = shuffled
    q = run(O.rate_limit(stream, ["k"], "ts", 2, "12 hours", ties=("i",)), "in_order_limits", tmp_path / "ck")
    assert len([p for p in q.recentProgress if p.numInputRows]) == 10
    got = spark.table("in_order_limits").groupBy("k").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    want = A.window_limits(batch, "k", F.col("ts"), 12 * 3_600_000_000, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select("k", "accepted", "rejected").collect()), key=repr)
    # which of the rows, too: the first two of each window
    rows, at, n = [], {}, {}
    for r in sorted(batch.collect(), key=lambda r: (r.ts, str(r.i))):
        if r.k not in at or (r.ts - at[r.k]).total_seconds() >= 12 * 3600:
            at[r.k], n[r.k] = r.ts, 0
        n[r.k] += 1
        rows.append((r.k, r.i, n[r.k] <= 2))
    assert sorted((r.k, r.i, r.accepted) for r in spark.table("in_order_limits").where("k is not null").collect()) == sorted(x for x in rows if x[0] is not None)
    # all that waits in the end is the row that ended it
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "ck"))
    assert [r.k for r in waiting.select("key.k").collect()] == ["end"]
    assert spark.read.format("statestore").option("stateVarName", "value").load(str(tmp_path / "ck")).count() == 0


def test_duplicates_in_event_order(spark, shuffled, tmp_path):
    batch, stream = shuffled
    run(O.suppress_duplicates(stream, ["k"], "ts", "12 hours"), "in_order_kept", tmp_path / "ck")
    got = spark.table("in_order_kept").groupBy("k").agg(F.count("*").alias("n"))
    want = A.window_limits(batch, "k", F.col("ts"), 12 * 3_600_000_000, 1).select("k", "accepted")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def plain(rows):
    return sorted(((r.channel, r.session_id, r.customer_id, sorted(r.metadata.items(), key=repr), [tuple(t) for t in r.transcript]) for r in rows), key=repr)


def test_sessions_are_the_batch_form(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["web", "call"]), f"s{rng.randint(0, 4)}", i, rng.choice(["user", "assistant", None]), f"text {i}", rng.choice([None, None, f"c{i % 3}"]), rng.choice([None, {}, {"a": str(i)}, {"b": None, "c": str(i)}])) for i in range(120)]
    rows += [("web", None, 5, "user", "no session", None, None), ("web", "s1", None, "user", "no turn", None, {"a": "never"})]
    rng.shuffle(rows)
    for n in range(6):
        spark.createDataFrame(rows[n * 21 : (n + 1) * 21], O.TURN).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(O.TURN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    last = {}

    def keep(batch, n):
        for r in batch.collect():
            last[r.channel, r.session_id] = r

    q = O.sessions(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = O.sessions_of(spark.createDataFrame(rows, O.TURN).coalesce(1))
    assert plain(last.values()) == plain(want.collect())
    assert max(len(r.transcript) for r in last.values()) > 5


def test_changes_need_no_store(spark, tmp_path):
    schema = "name string, hash string, arrived int"
    days = [[("f", "1", 1), ("g", "1", 1), (None, "0", 1)], [("f", "1", 2), ("g", "2", 2), ("g", "9", 1)], [("f", "1", 3), ("g", "1", 3), ("h", None, 3)], [("f", "1", 4), ("h", None, 4)]]
    kept = []
    for day in days:
        spark.createDataFrame(day, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        got = O.changed(X.files(spark, f"{tmp_path}/src", schema), ["name"], "hash", "arrived")
        q = got.writeStream.format("parquet").option("path", f"{tmp_path}/store").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
        kept.append(spark.read.parquet(f"{tmp_path}/store").count())
        # the one source is what came: nothing of the store is read
        assert [s.description for p in q.recentProgress for s in p.sources if "/src" not in s.description] == []
    assert kept == [3, 4, 6, 6]
    assert sorted((r.name or "", r.hash or "", r.version) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [("", "0", 1), ("f", "1", 1), ("g", "1", 1), ("g", "1", 3), ("g", "2", 2), ("h", "", 1)]
