"""A kept inverted index, polls by change time, and names in long texts."""

import datetime as dt
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewater.operators import merges as M
from tidewater.operators.index import Index
from tidewater.streaming.changes import Changes

ROWS = "id long, terms array<string>"


def brute(rows, queries):
    return sorted((q, i, len(set(t)), sorted(n for x, n in Counter(held or []).items() if x in t)) for q, t in queries for i, held in rows.items() if set(held or []) & set(t))


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, LongType(), f"{tmp_path}/index", buckets=4, most=3)


def test_index_over_segments(spark, index):
    rng = random.Random(2)
    words = ["the", "red", "ring", "bolt", "é", "x"]
    queries = [(1, ["the", "ring"]), (2, ["bolt"]), (3, ["nothing"]), (4, ["red", "red", "x"])]
    asked = spark.createDataFrame(queries, "query_id int, terms array<string>")
    held, seen = {}, []
    assert index.search(asked).collect() == []
    for n in range(6):
        new = {rng.randint(0, 40): ["the"] * rng.randint(0, 2) + rng.choices(words, k=rng.randint(0, 4)) for _ in range(15)}
        new |= {100 + n: None, 200: []} if n else {200: ["bolt"], 201: [None, "x"]}
        index.add(spark.createDataFrame(list(new.items()), ROWS))
        held |= {i: [t for t in v or [] if t] for i, v in new.items()}
        seen.append(index.segments())
        assert sorted((r.query_id, r.id, r.n_terms, r.counts) for r in index.search(asked).collect()) == brute(held, queries)
        assert {r.term: r.df for r in index.frequencies().collect()} == Counter(t for v in held.values() for t in set(v))
    # adding writes one segment; too many become one
    assert seen[:3] == [["000001-part"], ["000001-part", "000002-part"], ["000001-part", "000002-part", "000003-part"]] and seen[3] == ["000005-full"]
    assert {r.term: r.df for r in index.frequencies(spark.createDataFrame([("the",), ("q",)], "term string")).collect()} == {"the": sum("the" in v for v in held.values())}


def test_a_segment_that_is_not_whole_does_not_count(spark, index):
    index.add(spark.createDataFrame([(1, ["a"])], ROWS))
    spark.createDataFrame([("a", 2, 1, 0)], index.postings_of).write.partitionBy("_bucket").parquet(f"{index.path}/000002-part/postings")  # a writer died here
    assert [r.id for r in index.live().collect()] == [1] and len(index.segments()) == 1


def test_searches_read_the_folders_of_their_terms(spark, index):
    index.add(spark.createDataFrame([(i, [f"w{i % 50}", "common"]) for i in range(500)], ROWS))
    buckets = [r.b for r in spark.createDataFrame([("w7",)], "t string").select(index._bucket(F.col("t")).alias("b")).collect()]
    found = index.live(buckets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = [r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all(f"_bucket={buckets[0]}" in f for f in files)


def test_changes_come_once(spark, tmp_path):
    spark.dataSource.register(Changes)
    schema = "id long, changed timestamp, name string"
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)

    def change(*rows):
        spark.createDataFrame([(i, s if s is None else at(s), n) for i, s, n in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/table")

    def poll(until):
        stream = spark.readStream.format("changes").schema(schema).options(path=f"{tmp_path}/table", time="changed", id="id").load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="100 milliseconds").start()
        began = time.time()
        while time.time() - began < 90:
            q.processAllAvailable()
            if spark.read.schema(schema).parquet(f"{tmp_path}/out").count() >= until:
                break
        q.stop()
        return sorted((r.id, r.name) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    change((1, 1, "a"), (2, 2, "b"), (3, 2, "c"), (9, None, "no time"), (None, 3, "no id"))
    first = poll(3)
    assert first == [(1, "a"), (2, "b"), (3, "c")]
    # more at the same moment, and a row that changes again; the restart goes on
    change((4, 2, "d"), (5, 2, "e"), (1, 7, "a again"))
    second = poll(6)
    assert second == sorted([*first, (4, "d"), (5, "e"), (1, "a again")])
    assert poll(6) == second  # nothing twice
    change((6, 8, "f"))
    assert poll(7) == sorted([*second, (6, "f")])


def test_polls_leave_moments_that_may_grow(spark, tmp_path):
    from tidewater.streaming.changes import ChangeReader

    schema = spark.createDataFrame([], "id long, changed timestamp").schema
    now = int(time.time() * 1e6)
    spark.createDataFrame([(1, now - 60_000_000), (2, now - 60_000_000), (3, now)], "id long, t long").select("id", F.timestamp_micros("t").alias("changed")).write.parquet(f"{tmp_path}/t")
    reader = ChangeReader({"path": f"{tmp_path}/t", "time": "changed", "id": "id", "settle": "20 seconds"}, schema)
    end = reader.latestOffset()
    assert end == {"time": now - 60_000_000, "id": 2}
    assert sum(b.num_rows for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p)) == 2
    assert reader.latestOffset() == end
    assert ChangeReader({"path": f"{tmp_path}/absent", "time": "changed", "id": "id"}, schema).latestOffset() == {"time": None, "id": None}


def test_names_in_a_long_text(spark):
    rng = random.Random(3)
    names = [f"supplier#{i:05d}" for i in range(3000)] + ["a", "ab", "b" * 50]
    title = " ".join(rng.choice(["call", "about", "the", "invoice", "supplier#"]) for _ in range(150_000)) + " supplier#00042 ab" + " supplier#02999"
    assert len(title) > 800_000
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    for group in (1_000_000, 10_000):
        got = {r.p for r in M.contained(one(names, "p"), "p", one([title, title, None, ""], "t"), "t", group=group).collect()}
        assert got == {n for n in names if n in title}
    assert M.contained(one([], "p"), "p", one([title], "t"), "t").count() == 0 == M.contained(one(names, "p"), "p", one([], "t"), "t").count()
