"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

Vectors are taken in descending order of length. A query's k-th best score so far, theta,
prunes: |q||x| < theta ends the scan (Cauchy-Schwarz); for the rest the first coordinates
in the SVD basis give a partial sum, and partial + |rest of q||rest of x| < theta drops a
vector. What is left is scored in whole numbers, so the result is exact.

Queries are taken in blocks of bounded size that are sent to all tasks; candidates stay
where they are and are never paired with all queries in a shuffle. A task keeps k rows a
query, and those meet by query.

Nulls and edge cases: a vector that is null, or holds a null or a component that isn't
finite, takes no part; so does a null vec_id. Vectors of different length are compared
over the components both have; the basis takes the square of the longest one's length in
memory. Ties go to the smaller vec_id. Rows with equal vec_id are candidates each (but never
answers to their own id), and queries each: every such row gets its own ranks 1 to k, under
the same query_id. Quantized components must be below 2^28 in size. Without
queries or candidates the result is empty. The result has the named columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, load, stash

SCALE = 1024
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 1_024
#: Query blocks whose scans run as one job.
BLOCKS_AT_ONCE = 16
#: Vectors that a task takes at a time.
ROWS = 2_048


def quantize(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(1024 * x) of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, n) in enumerate(zip(ends, size, strict=False)):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from their Gram matrix (width * width sums)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column("v"), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("v").mapInArrow(gram, "i int, row array<double>")
    sums = rows.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(width)]).alias("row")).collect()
    total = np.zeros((width, width))
    for r in sums:
        total[r.i] = r.row
    return np.linalg.eigh(total)[1][:, ::-1]


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        self.n = np.zeros(n, int)

    def theta(self) -> np.ndarray:
        return np.where(self.n >= self.k, self.score[:, -1].astype(float), -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q, : self.n[q]], score]), np.concatenate([self.id[q, : self.n[q]], ids])
        o = np.lexsort((i, -s))[: self.k]
        self.n[q] = len(o)
        self.score[q, : len(o)], self.id[q, : len(o)] = s[o], i[o]


def scan(block: tuple[np.ndarray, np.ndarray], basis: np.ndarray, k: int, head: int, floor: np.ndarray | None, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Best:
    """The k best of batches (ids, vectors), which come by descending length, for a block of queries."""
    ids, q = block
    qr = q.astype(float) @ basis
    q_len, q_rest = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    best = Best(len(ids), k)
    low = floor if floor is not None else np.full(len(ids), -np.inf)
    for x_ids, x in batches:
        xf = x.astype(float)
        length = np.sqrt((xf**2).sum(1))
        theta = np.maximum(best.theta(), low)
        slack = 1e-6 * (q_len * (length.max() if len(length) else 0) + 1)
        live = np.flatnonzero(q_len * (length.max() if len(length) else 0) + slack >= theta)
        if not len(live):
            continue  # shorter ones follow, until the task comes to its next file
        xr = xf @ basis
        rest = np.sqrt((xr[:, head:] ** 2).sum(1))
        bound = qr[live, :head] @ xr[:, :head].T + q_rest[live, None] * rest[None, :] + slack[live, None]
        keep = (bound >= theta[live, None]) & (q_len[live, None] * length[None, :] + slack[live, None] >= theta[live, None])
        for j, r in zip(live, keep, strict=True):
            at = np.flatnonzero(r)
            at = at[x_ids[at] != ids[j]]
            if len(at):
                s = x[at] @ q[j]
                ok = s >= max(theta[j], -np.inf)
                best.add(j, s[ok], x_ids[at][ok])
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, head: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries(vec_id) against vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    all_ = stash(quantize(vectors.select("vec_id", "embedding")), "topk_vectors")
    width = all_.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotation(all_, width)
    head = min(head, width)
    length = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    # each part is in descending order of length, and so are its blocks
    ordered = stash(all_.withColumn("_length", length).repartition(F.pmod(F.xxhash64("vec_id"), F.lit(4096))).sortWithinPartitions(F.col("_length").desc(), "vec_id"), "topk_sorted")
    asked = stash(all_.join(queries.select("vec_id").where("vec_id is not null").distinct(), "vec_id").withColumn("_q", F.monotonically_increasing_id()), "topk_queries")
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    longest = [(np.array([r.vec_id for r in rows]), np.array([list(r.v) + [0] * (width - len(r.v)) for r in rows], np.int64).reshape(-1, width)) for rows in [all_.withColumn("_length", length).orderBy(F.col("_length").desc(), "vec_id").limit(ROWS).select("vec_id", "v").collect()]]
    # by number, not by id: rows with equal ids are queries each
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), "vec_id"))
    best = lambda parts: reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    done: list[DataFrame] = []
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        parts, sent = [], []
        for b in range(first, min(blocks, first + BLOCKS_AT_ONCE)):
            mine = asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b).select("_q", "vec_id", "v").collect()  # about QUERY_BLOCK rows
            if not mine:
                continue
            block = np.array([r.vec_id for r in mine]), np.array([list(r.v) + [0] * (width - len(r.v)) for r in mine], np.int64).reshape(-1, width)
            floor = scan(block, basis, k, head, None, iter(longest)).theta()  # the longest vectors give every task a first bound
            sent.append(spark.sparkContext.broadcast((block, np.array([r["_q"] for r in mine]), basis, floor)))
            parts.append(ordered.select("vec_id", "v").mapInArrow(_scanner(sent[-1], width, k, head), "_q long, query_id long, vec_id long, score long"))
        if parts:
            # a query is in one block only: what is found for it is reduced to k rows and written once
            done.append(stash(best(parts), "topk_found"))
        for x in sent:
            x.destroy()
    discard(all_, ordered, asked)  # what is found has been written
    return reduce(DataFrame.union, done) if done else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _scanner(sent, width: int, k: int, head: int):
    """What a task does with a block of queries: its k best rows for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, basis, floor = sent.value

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                ids, m = b.column("vec_id").to_numpy(), _matrix(b.column("v"), width)
                for i in range(0, len(ids), ROWS):
                    yield ids[i : i + ROWS], m[i : i + ROWS]

        best = scan(block, basis, k, head, floor, parts())
        some = np.flatnonzero(best.n)
        q, n = (np.repeat(x[some], best.n[some]) for x in (block[0], number))
        has = np.arange(k)[None, :] < best.n[some][:, None]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (n, q, best.id[some][has], best.score[some][has])], ["_q", "query_id", "vec_id", "score"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 10
"""
