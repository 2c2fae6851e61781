"""Readers and writers: tables, CSV cells, folders of documents, spreadsheets, JSON payloads, JSONL outboxes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import records
from ..functions import text as T

DOCUMENTS = ("md", "txt", "csv", "tsv", "html", "docx", "xlsx")
LEAST_TEXT = 20


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table; naming columns reads no others."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_cells(spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",") -> DataFrame:
    """A CSV with a header: cells are trimmed, empty ones are null, values that don't fit their type are null."""
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])
    return raw if schema is None else raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def labelled_lines(rows: DataFrame) -> DataFrame:
    """(line): 'Header: value | Header: value', empty cells left out."""
    return rows.select(F.concat_ws(" | ", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in rows.columns]).alias("line"))


def walk_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, kind) of all documents below a folder; lock files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(~F.col("path").rlike(r"/~\$[^/]*$")).withColumn("kind", kind).where(F.col("kind").isin(*DOCUMENTS))


def _sheets(content: bytes) -> str:
    """Cells of a workbook as labelled lines below a heading a sheet; formulas count by their results."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
        shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for i, name in enumerate(names, 1):
            out.append(f"## Sheet: {name}")
            head: dict[str, str] = {}
            for k, row in enumerate(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iterfind(".//m:row", ns)):
                cells = {}
                for c in row.iterfind("m:c", ns):
                    v, col = c.find("m:v", ns), re.sub("[0-9]", "", c.get("r", ""))
                    said = "".join(t.text or "" for t in c.iterfind(".//m:t", ns)) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells[col] = said.strip()
                if not k:
                    head = cells
                elif any(cells.values()):
                    out.append(" | ".join(f"{head.get(c) or c}: {v}" for c, v in cells.items() if v))
        return "\n".join(out)


def _paragraphs(content: bytes) -> str:
    """A document's paragraphs; headings get #, list items -."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{w}p"):
        said = "".join(t.text or "" for t in p.iter(f"{w}t"))
        style = next((s.get(f"{w}val", "") for s in p.iter(f"{w}pStyle")), "")
        level = re.fullmatch(r"Heading([1-6])", style)
        out.append(("#" * int(level[1]) + " " if level else "- " if p.find(f"{w}pPr/{w}numPr") is not None else "") + said)
    return "\n\n".join(x for x in out if x.strip())


def _delimited(content: str, sep: str) -> str:
    import csv

    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(content), delimiter=sep)]
    return "\n".join(" | ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False) if v) for r in rows[1:] if any(r)) if rows else ""


def extract_text(files: DataFrame) -> DataFrame:
    """(path, kind, text, status, error) from walk_documents(); a file that can't be read fails alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b.column("path").to_pylist(), b.column("kind").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    if kind == "xlsx":
                        said = _sheets(content)
                    elif kind == "docx":
                        said = _paragraphs(content)
                    elif kind in ("csv", "tsv"):
                        said = _delimited(content.decode(), "," if kind == "csv" else "\t")
                    else:
                        said = content.decode()
                    rows.append((path, kind, said, None))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["path", "kind", "text", "error"])

    got = files.select("path", "kind", "content").mapInArrow(run, "path string, kind string, text string, error string")
    text = T.clean(F.when(F.col("kind") == "html", T.html_to_text(F.col("text"))).otherwise(F.col("text")))
    got = got.withColumn("text", text)
    short = F.coalesce(F.length("text"), F.lit(0)) < LEAST_TEXT
    return got.select("path", "kind", "text", F.when(F.col("error").isNotNull() | short, "failed").otherwise("ok").alias("status"), F.coalesce("error", F.when(short, "too little text")).alias("error"))


def infer_document_type(path: Column) -> Column:
    """The kind of a document from its folder, else its name."""
    p = F.lower(path)
    out = F.lit("other")
    for word, kind in (("training", "training"), ("support", "support_guidelines"), ("catalog", "product_catalog"), ("product", "product_catalog"), ("warranty", "warranty_policy"), ("shipping", "shipping_policy"), ("delivery", "shipping_policy"), ("return", "return_policy"), ("refund", "return_policy")):
        out = F.when(p.contains(word), kind).otherwise(out)
    return out


CALL = (
    "message struct<toolCalls:array<struct<id:string,function:struct<name:string,arguments:map<string,string>>>>,"
    "toolCallList:array<struct<id:string,function:struct<name:string,arguments:map<string,string>>>>,"
    "analysis:struct<structuredData:map<string,string>>,call:struct<id:string,customer:struct<number:string>>>, name string, phone string, email string, budget string"
)


def voice_calls(raw: DataFrame, column: str = "value") -> DataFrame:
    """One record a payload, whichever of its four shapes it has; the first value that isn't empty wins."""
    j = F.from_json(F.col(column), CALL)
    first = lambda calls: F.when(F.size(calls) > 0, calls[0]["function"]["arguments"])
    places = [first(j["message"]["toolCalls"]), first(j["message"]["toolCallList"]), j["message"]["analysis"]["structuredData"]]
    pick = lambda k: F.coalesce(*[F.nullif(F.trim(m[k]), F.lit("")) for m in places], F.nullif(F.trim(j[k]), F.lit("")))
    return raw.select(j["message"]["call"]["id"].alias("call_id"), pick("name").alias("name"), F.coalesce(pick("phone"), j["message"]["call"]["customer"]["number"]).alias("phone"), pick("email").alias("email"), pick("budget").alias("budget"))


def salvage_json(text: Column, schema: str) -> Column:
    """The object in an answer: a fenced block, else the outermost braces; null if there is none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.from_json(F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))), schema)


def append_outbox(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, without secrets and with personal data masked, at any depth."""
    records.redact(rows).write.mode("append").option("ignoreNullFields", "false").json(path)


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, text): heading, bullet, divider, code or paragraph, a row a line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line")).where(F.length(F.trim("line")) > 0)
    kind = F.when(F.col("line").rlike(r"^#{1,6}\s"), "heading").when(F.col("line").rlike(r"^\s*[-*]\s"), "bullet").when(F.col("line").rlike(r"^\s*(---|\*\*\*)\s*$"), "divider").when(F.col("line").rlike(r"^(```|    )"), "code").otherwise("paragraph")
    return rows.select("doc_id", "block", kind.alias("kind"), F.trim(F.regexp_replace("line", r"^\s*(#{1,6}|[-*])\s+", "")).alias("text"))
