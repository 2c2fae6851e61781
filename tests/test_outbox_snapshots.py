"""Retries over restarts, and tables that change together."""

import hashlib
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import knowledge as K
from tidewater.sources import snapshots as S
from tidewater.streaming import outbox as B


def until(check, seconds=150):
    began = time.time()
    while not check():
        assert time.time() - began < seconds, "it took too long"
        time.sleep(0.3)


def test_retries_over_a_restart(spark, tmp_path):
    log = str(tmp_path / "sent")

    def send(due):
        with open(log, "a") as f:  # what the receiver sees
            f.writelines(f"{i} {n}\n" for i, n in zip(due["id"], due["attempt"], strict=True))
        bad = {"third": 4, "never": 99}
        return pd.Series([None if n >= bad.get(i, 1) else f"no {n}" for i, n in zip(due["id"], due["attempt"], strict=True)], index=due.index)

    def events(*ids):
        spark.createDataFrame([(i, "mail", f"for {i}") for i in ids], B.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")

    def start():
        rows = spark.readStream.schema(B.EVENT).parquet(f"{tmp_path}/events")
        return B.deliver(rows, send, f"{tmp_path}/outcomes", f"{tmp_path}/ck", backoff="100 milliseconds", every="0 seconds")

    def told():
        try:
            return {r.id: r for r in B.statuses(spark.read.option("recursiveFileLookup", "true").schema(B.OUTCOME).parquet(f"{tmp_path}/outcomes")).collect()}
        except Exception:  # noqa: BLE001  a file list that is being replaced
            return {}

    events("once", "third", "never", "once", None)
    q = start()
    until(lambda: told().get("third") and told()["third"].attempts >= 2)
    q.stop()
    events("once", "more")  # known already, and new
    q = start()
    until(lambda: (t := told()) and t.get("more") and t["third"].status == "delivered" and t["never"].status == "given up")
    time.sleep(2)
    q.stop()
    got = told()
    assert {i: (r.status, r.attempts, r.last_error, r.destination) for i, r in got.items()} == {"once": ("delivered", 1, None, "mail"), "more": ("delivered", 1, None, "mail"), "third": ("delivered", 4, None, "mail"), "never": ("given up", 5, "no 5", "mail")}
    rows = spark.read.option("recursiveFileLookup", "true").schema(B.OUTCOME).parquet(f"{tmp_path}/outcomes").collect()
    assert max(Counter((r.id, r.attempt) for r in rows).values()) == 1 and len(rows) == 1 + 1 + 4 + 5
    assert {r.payload for r in rows if r.id == "third"} == {"for third"}


def test_a_recorded_batch_sends_nothing_again(spark, tmp_path):
    """A batch that runs again after its outcomes were written, but before it was committed."""
    folder = f"{tmp_path}/outcomes"
    assert not B._recorded(spark, f"{folder}/0")
    spark.createDataFrame([("a", "mail", "x", 1)], B.DUE).mapInPandas(B._attempt(lambda d: pd.Series([None] * len(d))), B.OUTCOME).write.parquet(f"{folder}/0")
    assert B._recorded(spark, f"{folder}/0")


def test_a_raising_send_is_an_outcome():
    def send(due):
        raise ValueError("x" * 2000)

    (got,) = B._attempt(send)(iter([pd.DataFrame({"id": ["a", "b"], "attempt": [1, 1]})]))
    assert list(got["error"]) == ["x" * 1000] * 2


def test_first_attempts_of_a_batch_of_outcomes(spark):
    rows = [("a", "m", "p", n, e, None) for n, e in ((1, "x"), (2, None))] + [("b", "m", "p", n, "x", None) for n in range(1, 6)] + [("c", "m", "p", 1, "x", None)]
    got = B.statuses(spark.createDataFrame(rows, B.OUTCOME).withColumn("at", F.lit("2024-01-01").cast("timestamp")))
    assert sorted((r.id, r.status, r.attempts) for r in got.collect()) == [("a", "delivered", 2), ("b", "given up", 5), ("c", "failed", 1)]


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, f"{tmp_path}/store", S.KEYS, 4)


def arrive(store, *rows):
    return {(r.source, r.source_ref): (r.action, r.version) for r in S.replace_documents(store, store.spark.createDataFrame(list(rows), S.ARRIVAL)).collect()}


def text(n):
    return f"# Part {n}\n" + f"This is sentence {n} of a text that is long enough. " * (20 + n)


def held(store, version=None):
    docs = {(r.source, r.source_ref, r.version): r.status for r in store.read("documents", version=version).collect()}
    chunks = {(r.source, r.source_ref, r.version) for r in store.read("chunks", version=version).collect()}
    return docs, chunks


def test_documents_and_chunks_change_together(store):
    assert store.version() == 0 and store.read("documents") is None
    assert arrive(store, ("s", "a", text(1), 1), ("s", "b", text(2), 1), (None, "c", text(3), 1), ("s", "e", None, 1)) == {("s", "a"): ("created", 1), ("s", "b"): ("created", 1), (None, "c"): ("created", 1), ("s", "e"): ("created", 1)}
    assert arrive(store, ("s", "a", text(4), 2), ("s", "a", "older", 0), ("s", "b", text(2), 2), (None, "c", text(5), 2)) == {("s", "a"): ("updated", 2), ("s", "b"): ("skipped", 1), (None, "c"): ("updated", 2)}
    docs, chunks = held(store)
    assert docs == {("s", "a", 1): "superseded", ("s", "a", 2): "active", ("s", "b", 1): "active", (None, "c", 1): "superseded", (None, "c", 2): "active", ("s", "e", 1): "active"}
    assert chunks == {("s", "a", 2), ("s", "b", 1), (None, "c", 2)}
    got = [(r.chunk_index, r.section, r.chunk_text) for r in store.read("chunks").where("source_ref = 'a'").orderBy("chunk_index").collect()]
    assert got == [(k, s, t) for k, (s, t, _) in enumerate(K.chunks(text(4)))]
    assert {r.hash for r in store.read("documents").where("source_ref = 'a' and version = 2").collect()} == {hashlib.sha256(text(4).encode()).hexdigest()}
    # the version before is as it was
    assert held(store, 1)[0] == {("s", "a", 1): "active", ("s", "b", 1): "active", (None, "c", 1): "active", ("s", "e", 1): "active"}


def test_nothing_new_makes_no_version(store):
    arrive(store, ("s", "a", text(1), 1))
    arrive(store, ("s", "a", text(1), 2))
    assert store.version() == 1
    assert arrive(store) == {} and store.version() == 1


def test_only_touched_buckets_are_written(store):
    arrive(store, *[("s", f"d{i}", text(i), 1) for i in range(12)])
    before = store.manifest()["tables"]
    arrive(store, ("s", "d3", text(99), 2))
    after = store.manifest()["tables"]
    for name in ("documents", "chunks"):
        moved = [b for b in before[name]["buckets"] if before[name]["buckets"][b] != after[name]["buckets"][b]]
        assert len(before[name]["buckets"]) == 4 and len(moved) == 1


def test_a_writer_that_dies_leaves_the_old_version(store):
    arrive(store, ("s", "a", text(1), 1))
    was = held(store)
    store.write({"documents": store.read("documents").withColumn("status", F.lit("broken")), "chunks": store.read("chunks").limit(0)})  # and no manifest
    assert store.version() == 1 and held(store) == was
    assert store.sweep() >= 1 and held(store) == was
    assert arrive(store, ("s", "a", text(2), 2)) == {("s", "a"): ("updated", 2)}


def test_of_two_writers_one_fails(store):
    arrive(store, ("s", "a", text(1), 1))
    docs, chunks = store.read("documents"), store.read("chunks")
    touched = list(range(4))
    assert store.commit({"documents": docs.withColumn("status", F.lit("first")), "chunks": chunks}, touched, 1) == 2
    with pytest.raises(S.Conflict):
        store.commit({"documents": docs.withColumn("status", F.lit("second")), "chunks": chunks}, touched, 1)
    assert {r.status for r in store.read("documents").collect()} == {"first"} and store.version() == 2
    assert arrive(store, ("s", "z", text(1), 1)) == {("s", "z"): ("created", 1)}


def test_old_versions_are_swept(store):
    for n in range(4):
        arrive(store, ("s", "a", text(n), n))
    assert store.sweep(keep=1) > 0
    assert held(store)[0] == {("s", "a", 1): "superseded", ("s", "a", 2): "superseded", ("s", "a", 3): "superseded", ("s", "a", 4): "active"}
    assert store.version() == 4
