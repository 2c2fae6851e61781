"""Every query of the business catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidewater.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("TIDEWATER_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, DATA)
    cur = db.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    at = [names.index(c) for c in order]
    assert key(got.select(*order).collect()) == key([tuple(r[i] for i in at) for r in cur.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_support_queue_view_has_every_ticket(spark, db, tmp_path):
    for t in ("customer", "orders"):
        os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.sql("SELECT id AS event_id, id % 50 AS user_id, 'error' AS event_type, timestamp_seconds(id) AS ts, CAST(id % 60 AS DOUBLE) AS value FROM range(1000)").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["support_queue_view"](spark, str(tmp_path)).distinct().count() == 1000
