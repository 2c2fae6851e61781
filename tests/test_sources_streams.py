"""Readers, writers and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.sources import files as S
from tidewater.streaming import stateful as X


def test_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name, Budget,Note\n Ann ,"1,200","say ""hi"""\nBob,x,\n')
    rows = S.read_cells(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.collect()] == [("Ann", "1,200", 'say "hi"'), ("Bob", "x", None)]
    assert [r.line for r in S.labelled_lines(rows).collect()] == ['Name: Ann | Budget: 1,200 | Note: say "hi"', "Name: Bob | Budget: x"]


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# Title\nA long enough line of text.")
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "~$b.txt").write_text("a lock file that must not be read")
    (tmp_path / "c.csv").write_text("Item,Price\nPhone,200000\nCharger,\n")
    (tmp_path / "d.xlsx").write_bytes(b"no workbook")
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Stock"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>Item</t></is></c><c r="B1" t="inlineStr"><is><t>Count</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>Phone</t></is></c><c r="B2"><v>7</v></c></row><row/></sheetData></worksheet>')
    got = {r.path.rsplit("/", 1)[1]: r for r in S.extract_text(S.walk_documents(spark, str(tmp_path))).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.md": "ok", "b.txt": "failed", "c.csv": "ok", "d.xlsx": "failed", "e.xlsx": "ok"}
    assert got["c.csv"].text == "Item: Phone | Price: 200000\nItem: Charger"
    assert got["e.xlsx"].text == "## Sheet: Stock\nItem: Phone | Count: 7"


def test_voice_calls_and_salvage(spark):
    raw = [
        {"message": {"toolCalls": [{"id": "1", "function": {"name": "f", "arguments": {"name": "Ann", "phone": "0300"}}}], "call": {"id": "c1"}}},
        {"message": {"analysis": {"structuredData": {"name": "Bob"}}, "call": {"id": "c2", "customer": {"number": "+92"}}}},
        {"name": "Cyd", "budget": "2 lakh"},
    ]
    got = S.voice_calls(spark.createDataFrame([(json.dumps(r),) for r in raw], "value string")).collect()
    assert [(r.call_id, r.name, r.phone) for r in got] == [("c1", "Ann", "0300"), ("c2", "Bob", "+92"), (None, "Cyd", None)]
    said = spark.createDataFrame([('ok\n```json\n{"a": 1}\n```',), ('x {"a": 2} y',), ("none",)], "t string")
    assert [r.j and r.j.a for r in said.select(S.salvage_json(F.col("t"), "a int").alias("j")).collect()] == [1, 2, None]


def test_outbox_and_blocks(spark, tmp_path):
    sent = spark.createDataFrame([("x", "secret", ("Bearer 1", "a@b.com"))], "body string, token string, request struct<Authorization: string, email: string>")
    S.append_outbox(sent, str(tmp_path / "o"))
    got = spark.read.json(str(tmp_path / "o")).first()
    assert (got.body, got.token, got.request.Authorization, got.request.email) == ("x", "[REDACTED]", "[REDACTED]", "a***@b.com".replace("***", "*"))
    blocks = S.markdown_blocks(spark.createDataFrame([(1, "# H\n\n- one\n---\nplain")], "doc_id int, text string")).orderBy("block").collect()
    assert [(b.kind, b.text) for b in blocks] == [("heading", "H"), ("bullet", "one"), ("divider", "---"), ("paragraph", "plain")]


@pytest.fixture
def calls(spark, tmp_path):
    rows = [("a", h) for h in (0, 20, 30, 55, 60)] + [("b", 1)]
    df = spark.createDataFrame(rows, "k string, h int").select("k", "h", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("h"))).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return X.files(spark, str(tmp_path / "in"), "k string, h int, ts timestamp").withWatermark("ts", "1 hour")


def run(stream, name, tmp_path, spark):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_duplicates(spark, calls, tmp_path):
    got = run(X.suppress_duplicates(calls, ["k"], "ts"), "kept", tmp_path, spark)
    assert sorted((r.k, r.h) for r in got) == [("a", 0), ("a", 30), ("a", 55), ("b", 1)]


def test_stream_rate_limit(spark, calls, tmp_path):
    got = run(X.rate_limit(calls, ["k"], "ts", 1, "24 hours"), "limited", tmp_path, spark)
    assert sorted((r.k, r.h) for r in got if r.accepted) == [("a", 0), ("a", 30), ("a", 55), ("b", 1)]


def test_stream_ingest(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "name string, hash string, arrived int"
    for k, rows in enumerate([[("f", "1", 1), ("g", "1", 1)], [("f", "1", 2), ("g", "2", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        X.ingest(X.files(spark, src, schema), str(tmp_path / "store"), str(tmp_path / "ck2"), ["name"]).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "store")).count() == (2, 3)[k]
