"""Nearest vectors by cosine: exact over stored vectors, and over the cells that a query probes.

Vectors are stored once: numbered, plain arrays, in folders by kind (and by cell), so that a
filter on the kind reads no other folder. Queries are sent to the tasks in blocks of bounded
size; a task goes through its vectors and keeps k rows a query, in order of similarity and
then of the order columns. What is found are numbers of rows: the other columns are read for
the winners only. So no vector is shuffled or repeated, however many queries there are; work
is queries times the vectors that filters and cells leave.

The approximate form deals vectors into cells around centres that k-means finds on a bounded
sample of all rows, and a query only sees the cells of its nearest centres. How many, is
learned: queries drawn from the sample are searched exactly among it, and the fewest cells are
taken that find the wanted share of their true neighbours. Cells of any size are read by as
many tasks as they have files.

Nulls and edge cases: a null vector is an empty one, null components are 0; vectors of
different length are compared over the components that both have; a zero vector has similarity
0 to all; a similarity that isn't a number doesn't count; rows of equal similarity are ranked
by the order columns (whole numbers, nulls last) and then as they were stored; queries with
equal ids are queries each; without vectors or queries the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.shared import discard, stash

#: Queries sent at once; blocks whose scans are one job; of a task, vectors and queries that meet at once.
QUERY_BLOCK, BLOCKS_AT_ONCE, ROWS, SLICE = 4_096, 8, 4_096, 256
#: A table of winners up to this many rows is broadcast.
FEW = 200_000
MOST = np.iinfo(np.int64).max


def plain(c: Column | str) -> Column:
    """array<double> without nulls."""
    return F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array()).cast("array<double>"), lambda e: F.coalesce(e, F.lit(0.0)))


def store(rows: DataFrame, kind: str | None = None, name: str = "vectors", cells: Cells | None = None) -> DataFrame:
    """rows(embedding, ...) with _id and plain vectors, written in folders by kind and cell."""
    held = rows.schema["embedding"]
    is_plain = held.dataType == ArrayType(DoubleType(), False) and not held.nullable
    put = (rows if is_plain else rows.withColumn("embedding", plain("embedding"))).withColumn("_id", F.monotonically_increasing_id())
    put = put.withColumn("_cell", cells.of(F.col("embedding"))) if cells else put
    by = [c for c in (kind, "_cell" if cells else None) if c]
    got = stash(put, name, by)
    got.is_stored = True
    return got


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; of longer ones the first components, and shorter ones filled with zeros."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.minimum(np.diff(ends), width)
    out = np.zeros((len(ends) - 1, width))
    if len(size) and (np.diff(ends) == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    rows = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[rows, at] = flat[np.repeat(ends[:-1], size) + at]
    return out


def _lengths(column: pa.ListArray) -> np.ndarray:
    """Euclidean lengths, over all components."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return np.sqrt(np.bincount(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), flat[ends[0] : ends[-1]] ** 2, len(ends) - 1))


@dataclass
class Block:
    """Queries that are sent to the tasks: numbers, vectors, lengths, and the cells each probes (all, if None)."""

    number: np.ndarray
    vector: np.ndarray
    length: np.ndarray
    probes: np.ndarray | None = None


class Best:
    """Of each query the k rows with the highest similarity so far; ties go by keys (order columns, then number)."""

    def __init__(self, n: int, k: int, keys: int) -> None:
        self.k, self.n = k, np.zeros(n, int)
        self.score, self.keys = np.full((n, k), -np.inf), np.zeros((n, k, keys), np.int64)

    def least(self) -> np.ndarray:
        return np.where(self.n >= self.k, self.score[:, -1], -np.inf)

    def add(self, q: int, score: np.ndarray, keys: np.ndarray) -> None:
        score, keys = np.concatenate([self.score[q, : self.n[q]], score]), np.concatenate([self.keys[q, : self.n[q]], keys])
        order = np.lexsort((*keys.T[::-1], -score))[: self.k]
        self.n[q] = len(order)
        self.score[q, : len(order)], self.keys[q, : len(order)] = score[order], keys[order]


def _meet(block: Block, live: np.ndarray, best: Best, x: np.ndarray, length: np.ndarray, keys: np.ndarray, least: float) -> None:
    """Some queries of the block meet some vectors."""
    for lo in range(0, len(live), SLICE):
        q = live[lo : lo + SLICE]
        n = block.length[q][:, None] * length[None, :]
        with np.errstate(all="ignore"):
            s = np.where(n == 0, 0.0, block.vector[q] @ x.T / n)
            s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s) + 0.0
        s[~(s >= least)] = -np.inf  # what isn't a number, too
        k = min(best.k, s.shape[1])
        low = np.maximum(best.least()[q], np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        hits = (s >= low[:, None]) & (s > -np.inf)
        for j in np.flatnonzero(hits.any(1)):
            at = np.flatnonzero(hits[j])
            best.add(q[j], s[j, at], keys[at])


def _scanner(sent, k: int, least: float, order: int, probing: bool):
    """What a task does with a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        best, width, everyone = Best(len(block.number), k, order + 1), block.vector.shape[1], np.arange(len(block.number))
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                column = pa.concat_arrays([part.column("embedding")])
                x, length = _matrix(column, width), _lengths(column)
                keys = np.stack([*(part.column(f"_o{i}").to_numpy(zero_copy_only=False) for i in range(order)), part.column("_id").to_numpy()], axis=1)
                if not probing:
                    _meet(block, everyone, best, x, length, keys, least)
                    continue
                cell = part.column("_cell").to_numpy()
                for c in np.unique(cell):
                    at = cell == c
                    _meet(block, np.flatnonzero((block.probes == c).any(1)), best, x[at], length[at], keys[at], least)
        some = np.arange(k)[None, :] < best.n[:, None]
        cols = [pa.array(np.repeat(block.number, best.n), pa.int64()), pa.array(best.score[some], pa.float64()), *(pa.array(best.keys[some][:, i], pa.int64()) for i in range(order + 1))]
        yield pa.RecordBatch.from_arrays(cols, ["_q", "similarity", *(f"_o{i}" for i in range(order)), "_id"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, where: Column | None = None, order: list[Column] | None = None, cells: Cells | None = None) -> DataFrame:
    """(query_id, rank, the row's columns, similarity) for queries(query_id, query): filters before ranks.

    rows come from store(), or are stored first. With cells, rows must have been stored with
    them, and a query sees those cells only that it probes.
    """
    spark = rows.sparkSession
    held = rows if getattr(rows, "is_stored", False) else store(rows)
    seen = held if where is None else held.where(where)
    order = order or []
    kept = [c for c in held.columns if c not in ("embedding", "_id", "_cell")]
    narrow = seen.select("embedding", "_id", *[F.coalesce(o.cast("long"), F.lit(int(MOST))).alias(f"_o{i}") for i, o in enumerate(order)], *(["_cell"] if cells else []))
    asked = stash(queries.select("query_id", plain("query").alias("query")).withColumn("_q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("similarity"), *[f"_o{i}" for i in range(len(order))], "_id"))
    found = f"_q long, similarity double, {''.join(f'_o{i} long, ' for i in range(len(order)))}_id long"
    done: list[DataFrame] = []
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        parts, sent = [], []
        for n in range(first, min(blocks, first + BLOCKS_AT_ONCE)):
            mine = asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == n).select("_q", "query").collect()  # about QUERY_BLOCK rows
            if not mine:
                continue
            width = max(1, *(len(r["query"]) for r in mine))
            vector = np.array([list(r["query"]) + [0.0] * (width - len(r["query"])) for r in mine])
            block = Block(np.array([r["_q"] for r in mine]), vector, np.sqrt((vector**2).sum(1)))
            mine_seen = narrow
            if cells:
                block.probes = cells.nearest(block.vector)
                mine_seen = narrow.where(F.col("_cell").isin([int(c) for c in np.unique(block.probes)]))  # other cells' folders aren't read
            sent.append(spark.sparkContext.broadcast(block))
            parts.append(mine_seen.mapInArrow(_scanner(sent[-1], k, least, len(order), cells is not None), found))
        if parts:
            done.append(stash(reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= k), "found"))
        for x in sent:
            x.destroy()
    if not done:
        return spark.createDataFrame([], "_q long, rank int, similarity double, _id long").join(asked, "_q").join(held.select(*kept, "_id"), "_id").select("query_id", "rank", *kept, "similarity")
    won = reduce(DataFrame.union, done).join(asked.select("_q", "query_id"), "_q").select("query_id", "rank", "similarity", "_id")
    won = F.broadcast(won) if sum(d.count() for d in done) <= FEW else won
    return held.select(*kept, "_id").join(won, "_id").select("query_id", "rank", *kept, "similarity")


@dataclass
class Cells:
    """Centres of cells (unit vectors), and how many of them a query probes."""

    centres: np.ndarray
    probes: int
    recall: float = 1.0

    def of(self, vector: Column) -> Column:
        """The cell of a vector: that of the centre with the highest inner product; a zero vector's is the first."""
        centres = F.lit(self.centres.tolist())
        dots = F.transform(centres, lambda c: F.aggregate(F.zip_with(c, vector, lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0))))
        return F.coalesce(F.array_position(dots, F.array_max(dots)) - 1, F.lit(0)).cast("int")

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """The cells that each query probes."""
        w = min(queries.shape[1], self.centres.shape[1])
        with np.errstate(all="ignore"):
            return np.argsort(-np.nan_to_num(queries[:, :w] @ self.centres[:, :w].T), axis=1, kind="stable")[:, : self.probes]


def train(rows: DataFrame, cells: int = 64, recall: float = 0.95, k: int = 10, most: int = 20_000, asked: int = 400, seed: int = 1) -> Cells:
    """Cells for rows(embedding), by k-means on `most` rows at most, drawn from all rows by a hash.

    The probes are the fewest with which `asked` rows of the sample find the wanted share of
    their k nearest ones in the sample.
    """
    fine = rows.select(plain("embedding").alias("embedding")).where(F.size("embedding") > 0)
    width = fine.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return Cells(np.zeros((1, 1)), 1)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e * e))
    fine = fine.where(F.size("embedding") == width).where((length > 0) & ~F.isnan(length) & (length < float("inf")))
    total = fine.count()
    share = min(1.0, most / max(1, total) * 0.95)
    drawn = fine.where(F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("embedding", F.lit(seed)), "embedding").limit(most)
    sample = stash(drawn.select(F.transform("embedding", lambda e: e / length).alias("embedding")), "cell_sample")
    x = np.array([r.embedding for r in sample.collect()])  # most rows at most
    if not len(x):
        return Cells(np.zeros((1, width)), 1)
    many = max(1, min(cells, len(x) // 8))
    if many > 1:
        model = KMeans(k=many, seed=seed, maxIter=12, distanceMeasure="cosine", featuresCol="v").fit(sample.select(array_to_vector("embedding").alias("v")))
        centres = np.array(model.clusterCenters())
    else:
        centres = x.mean(0, keepdims=True)
    discard(sample)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    q = x[:: max(1, len(x) // asked)][:asked]
    own = np.argmax(x @ centres.T, axis=1)
    s = q @ x.T
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x))]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each centre, in the order of a query
    found = place[np.arange(len(q))[:, None], own[near]]
    shares = np.array([(found < p).mean() for p in range(1, len(centres) + 1)])
    probes = int(np.argmax(shares >= recall)) + 1
    return Cells(centres, probes, float(shares[probes - 1]))
