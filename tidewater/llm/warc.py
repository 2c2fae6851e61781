"""WARC archives with a two-level capture index.

write(): tasks write one gzip member a record into archive files of the shared folder, and
return where each record lies. index(): those captures, sorted by reversed-host URL key,
become files of compressed blocks of lines; a sparse directory keeps a row a block (first
key, file, offset, length).

locate() finds captures by key. The first keys of the index's files (MOST_FILES at most,
however many captures) say by binary search in which file a key lies. Keys meet the
directory rows of their file in one task, are searched among those by bisection, and the
block's range is read and searched the same way; keys come in order, so a block is read
once. read() reads the records' ranges, in the order of the archive files.

Files are named per attempt, and only those that a finished attempt returned are used, so
a lost executor leaves at most files that nobody reads.

Nulls and edge cases: a null html is an empty payload; a null url has an empty key and no
target line; line breaks in urls are escaped; very long payloads and urls are written and
read whole; a null page_id comes before all others, and its record has no number; rows with
the smallest page_id of a payload are all responses, also repeated ones, and captures with
equal key and page_id are all found; an empty table gives no files and an empty result;
results have the named columns only, whatever others the table has.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_below, listed, load, shared_dir, small, stash
from .urlfilter import LOWER, UPPER

#: Payloads from so many bytes on are stored once.
LEAST_BYTES = 100
#: Captures in a block of the index, and in a file of it, about; files of the index.
BLOCK_LINES, FILE_LINES, MOST_FILES = 3_000, 300_000, 10_000
#: Bytes after which a task starts a new archive file, and the compression level.
FILE_BYTES, LEVEL = 256 << 20, 4
#: Bytes of an archive that a reading task takes together.
STRETCH = 8 << 20
#: Stands for a null page_id in comparisons.
NO_ID, LAST_ID = -(1 << 63), (1 << 63) - 1
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, first_id long, block string, offset long, length long, n long"


@dataclass(frozen=True)
class Archive:
    """The folder; the directory, a row a block; the index's files by their first captures; bytes of the records."""

    root: str
    directory: DataFrame
    files: list[tuple[str, int, str]]
    size: int


def url_key(url: F.Column) -> F.Column:
    """Hosts reversed, so that a domain's captures are neighbours: org,example)/path?query."""
    host = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1), F.lit(""))
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response, or with `first` a revisit of that page's response."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if first is None else b"")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else root.replace("file:/", "file:///", 1) if root.startswith("file:/") else f"file://{root}")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def firsts(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(_digest, _first) of payloads that occur more than once: the smallest page_id."""
    narrow = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("_digest")).where(F.col("n") >= least)
    return narrow.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1").select("_digest", "_first")


def write(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[str, DataFrame]:
    """Writes a record per row; the folder and the captures (key, page_id, file, offset, length)."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("_digest"), url_key(F.col("url")).alias("key"))
    rows = rows.join(small(stash(firsts(pages, least), "warc_firsts")), "_digest", "left")
    rows = rows.withColumn("_first", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(root)
        fs.create_dir(at, recursive=True)
        name, out, offset = "", None, 0
        try:
            for b in batches:
                got = []
                for page_id, url, text, digest, key, first in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "_digest", "key", "_first")), strict=True):
                    if out is None:
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    data = _gzip(record(page_id, url, text.encode("utf-8", "surrogatepass"), digest, first))
                    out.write(data)
                    got.append((key, page_id, name, offset, len(data)))
                    offset += len(data)
                    if offset >= FILE_BYTES:
                        out.close()
                        out = None
                cols = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return root, stash(rows.select("page_id", "url", "html", "_digest", "key", "_first").mapInArrow(run, CAPTURE), "warc_captures")


def index(root: str, captures: DataFrame, lines: int = BLOCK_LINES) -> Archive:
    """Writes the captures as sorted, compressed blocks; the directory has a row a block."""
    n, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_FILES, n // FILE_LINES))
    in_order = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(root)
        fs.create_dir(at, recursive=True)
        name, offset, held = f"{uuid.uuid4().hex}.cdx.gz", 0, []
        out = None
        got = []

        def close(rows: list[list]) -> None:
            nonlocal offset, out
            if out is None:
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            data = _gzip("".join(json.dumps(r) + "\n" for r in rows).encode())
            out.write(data)
            got.append((rows[0][0], rows[0][1], name, offset, len(data), len(rows)))
            offset += len(data)

        try:
            for b in batches:
                held += [list(r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                while len(held) >= lines:
                    close(held[:lines])
                    held = held[lines:]
            if held:
                close(held)
        finally:
            if out is not None:
                out.close()
        cols = list(zip(*got, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["first_key", "first_id", "block", "offset", "length", "n"])

    directory = stash(in_order.mapInArrow(run, DIRECTORY), "warc_directory")
    first = directory.groupBy("block").agg(F.min(F.struct("first_key", F.coalesce("first_id", F.lit(NO_ID)).alias("id"))).alias("at"))
    return Archive(root, directory, sorted((r["at"].first_key, r["at"].id, r.block) for r in first.collect()), size)  # one row a file of the index


def _range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def _lines(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data, 31).splitlines()]


def locate(archive: Archive, asked: DataFrame) -> DataFrame:
    """The captures (key, page_id, file, offset, length) of the keys of asked, each once.

    asked(key) asks for all captures of the keys, asked(key, page_id) for those of the pairs.
    """
    if not archive.files:
        return asked.sparkSession.createDataFrame([], CAPTURE)
    keys, ids = listed([k for k, _, _ in archive.files], "string"), listed([i for _, i, _ in archive.files], "bigint")
    names = listed([f for _, _, f in archive.files], "string")
    n = len(archive.files)
    if "page_id" in asked.columns:
        low = high = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))
    else:
        low, high = F.lit(NO_ID), F.lit(LAST_ID)
    asked = asked.select(F.coalesce("key", F.lit("")).alias("key"), low.alias("lo"), high.alias("hi"))

    def starts(end: str, strict: bool):
        """Whether the i-th file starts before (key, end), or at it."""
        k, v = lambda i: F.element_at(keys, i + 1), lambda i: F.element_at(ids, i + 1)
        return lambda i: (k(i) < F.col("key")) | ((k(i) == F.col("key")) & ((v(i) < F.col(end)) if strict else (v(i) <= F.col(end))))

    since = F.greatest(F.lit(0), count_below(n, starts("lo", True)) - 1)
    until = count_below(n, starts("hi", False)) - 1
    wanted = asked.select("key", "lo", "hi", since.alias("_since"), until.alias("_until")).where("_since <= _until")
    wanted = wanted.select("key", "lo", "hi", F.explode(F.sequence("_since", "_until")).alias("_file"))
    rows = archive.directory.select((F.array_position(names, F.col("block")) - 1).cast("int").alias("_file"), F.col("first_key").alias("key"), F.coalesce("first_id", F.lit(NO_ID)).alias("lo"), "block", "offset", "length")
    both = rows.unionByName(wanted, allowMissingColumns=True).repartitionById(n, F.col("_file"))
    # directory rows of a file come first, and then what is asked of it, each in order
    both = both.sortWithinPartitions("_file", F.col("block").isNull(), "key", "lo", "hi").select("_file", "key", "lo", "hi", "block", "offset", "length")
    root = archive.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(root)
        now, blocks, held, done = None, [], (None, [], []), None
        for b in batches:
            out: list[list] = []
            for file, key, lo, hi, block, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != now:
                    now, blocks, held, done = file, [], (None, [], []), None
                if block is not None:
                    blocks.append(((key, lo), block, offset, length))
                    continue
                if (key, lo, hi) == done:
                    continue
                done = key, lo, hi
                i = max(0, bisect_left(blocks, (key, lo), key=lambda x: x[0]) - 1)
                while i < len(blocks) and blocks[i][0] <= (key, hi):
                    if held[0] != i:
                        lines = _lines(_range(fs, f"{at}/{blocks[i][1]}", *blocks[i][2:]))
                        held = i, lines, [(x[0], NO_ID if x[1] is None else x[1]) for x in lines]
                    out += held[1][bisect_left(held[2], (key, lo)) : bisect_right(held[2], (key, hi))]
                    i += 1
                if len(out) > 10_000:
                    yield _captures(out)
                    out = []
            yield _captures(out)

    return both.mapInArrow(run, CAPTURE)


def _captures(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])


def read(archive: Archive, captures: DataFrame, payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures' records; with payload, also that.

    Digests of responses are taken from the payload itself, those of revisits, whose
    payload isn't there, from the record's field.
    """
    root = archive.root
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), archive.size // (4 * STRETCH))
    rows = captures.select("file", "offset", "length", F.floor(F.col("offset") / F.lit(STRETCH)).alias("_stretch"))
    # dealt by the bytes of the records, not of these rows
    rows = rows.repartition(parts, "file", "_stretch").sortWithinPartitions("file", "offset")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payload]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(root)
        name, f = None, None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                got = []
                for file, offset, length in zip(*(b.column(k).slice(lo, 500).to_pylist() for k in ("file", "offset", "length")), strict=True):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, fs.open_input_file(f"{at}/{file}")
                    fields, body = parse(zlib.decompress(f.read_at(length, offset), 31))
                    page, refers = (fields.get(k, "<urn:page:>")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
                    full = fields["warc-type"] == "response"
                    row = (int(page) if page else None, len(body) if full else int(fields["warc-payload-length"]), hashlib.sha256(body).hexdigest() if full else fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], int(refers) if refers else None)
                    got.append((*row, body) if payload else row)
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=False)], names)
        if f is not None:
            f.close()

    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record is asked for by its key, found through the index and read back."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = index(*write(pages))
    return read(archive, locate(archive, pages.select(url_key(F.col("url")).alias("key"), "page_id")))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f
"""
