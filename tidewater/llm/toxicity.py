"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > j) = sigmoid(w.x - theta_j): all thresholds share one weight vector and stay
ordered. The prediction is the expected severity, the sum of P(grade > j).

Labels are binary, so grades are derived: 0 not toxic, 1 toxic, 2 toxic with a share of
marker words (words with high log-odds in the sample) of at least the toxic median.

Nulls and edge cases: a null text is an empty text; an empty text has no feature and gets
the severity of the intercepts alone; very long texts are read whole, and a word counts
once however often it comes; repeated rows are scored each, and rows with equal doc_id all
take its label (1 if labels disagree); a severity equal to the cut is rejected; without
labelled rows of both classes nothing is learned and every severity is 0; an empty table
gives an empty result; other columns stay, but for those named severity or toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .common import load, stash

#: Letters only, so punctuation stuck to a word doesn't hide it.
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class OrdinalModel:
    """weights by feature; thresholds ascending; cut: expected severity from which to reject."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    cut: float = 0.5
    prefix: int = 4

    def severity(self, text: str | None) -> float:
        if not self.thresholds:
            return 0.0
        z = sum(self.weights[f] for f in features(text, self.prefix) if f in self.weights)
        return float(sum(1 / (1 + np.exp(np.clip(t - z, -500, 500))) for t in self.thresholds))


def features(text: str | None, prefix: int = 4) -> set[str]:
    """Words of a text, and beginnings of its longer words: of prefix to prefix + 2 letters."""
    words = set(LETTERS.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in range(prefix, min(len(w), prefix + 3))}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, prefix: int = 4, least_texts: int = 3, least_ratio: float = 16.0, least_odds: float = 1.5, ridge: float = 1.0, steps: int = 300) -> OrdinalModel:
    """Learns from a bounded sample of labelled rows.

    max_labelled bounds the sample: a quarter of it toxic at most, the rest clean, taken in
    the order of a hash of doc_id. Each sampled text is read whole. A fifth of the sample is
    held out to choose the cut.

    The model's features are all words and beginnings of words that occur in least_texts
    sampled texts, whose log-odds of being toxic are least_odds or more, and whose likelihood
    ratio against chance is least_ratio or more (of many thousand features some differ by
    chance; 16 leaves next to none of those). Their number is bounded by the sample's.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled * (3 - 2 * k) // 4) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(features(t, prefix)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "found"])

    got = stash(rows.mapInArrow(sparse, "doc_id long, toxic int, found array<string>"), "toxic_sample")
    # whole texts become sets of features on the executors; only what the model uses comes to the driver
    size = {r.toxic: r.n for r in got.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel(prefix=prefix)
    kept = got.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= least_texts)
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n0 + 1.0))
    pos, n, base = F.col("pos"), F.col("n"), n1 / (n1 + n0)
    ratio = 2 * (F.when(pos > 0, pos * F.log(pos / (n * base))).otherwise(0.0) + F.when(n > pos, (n - pos) * F.log((n - pos) / (n * (1 - base)))).otherwise(0.0))
    best = [r.f for r in kept.where((ratio >= least_ratio) & (odds >= least_odds)).select("f").collect()]
    if not best:
        return OrdinalModel(prefix=prefix)
    at = {f: i for i, f in enumerate(sorted(best))}
    rows = got.select("doc_id", "toxic", F.array_intersect("found", F.lit(list(at))).alias("found"), F.size("found").alias("n")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.n, sorted(r.found)))
    x = Sparse([[at[f] for f in r.found] for r in rows], len(at))
    toxic = np.array([r.toxic for r in rows])
    dense = np.array([len(r.found) / max(1, r.n) for r in rows])
    grade = toxic + ((toxic == 1) & (dense >= np.median(dense[toxic == 1])))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(toxic[held])) < 2 or len(set(toxic[~held])) < 2:
        held[:] = False
    w, theta = _descend(x.of(~held), grade[~held], ridge, steps)
    cut = 0.5
    if held.any():
        s = _expected(x.of(held).times(w), theta)
        grid = np.linspace(0.1, 1.2, 45)
        good = [((s >= c) == (toxic[held] == 1)).mean() for c in grid]
        cut = float(np.median(grid[np.array(good) == max(good)]))
    # a text without any of the features is never rejected
    cut = max(cut, 1.01 * float(_expected(np.zeros(1), theta)[0]))
    return OrdinalModel({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, [float(t) for t in theta], cut, prefix)


class Sparse:
    """A matrix of zeros and ones, as the columns that are one in each row."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.rows, self.width = rows, width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], int)

    def of(self, chosen: np.ndarray) -> Sparse:
        return Sparse([r for r, k in zip(self.rows, chosen, strict=True) if k], self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], len(self.rows))

    def summed(self, d: np.ndarray) -> np.ndarray:
        """The transpose times d."""
        return np.bincount(self.col, d[self.row], self.width)


def _expected(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -500, 500)))).sum(1)


def _descend(x: Sparse, grade: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient descent on the ordinal likelihood with a ridge; classes weigh the same."""
    top = int(grade.max())
    share = np.bincount((grade > 0).astype(int), minlength=2)
    weight = np.where(grade > 0, 0.5 / max(1, share[1]), 0.5 / max(1, share[0]))
    w, theta = np.zeros(x.width), np.arange(top, dtype=float)
    vw, vt = np.zeros_like(w), np.zeros_like(theta)
    over = (grade[:, None] > np.arange(top)[None, :]).astype(float)
    rate = 0.5
    for _ in range(steps):
        z = x.times(w + 0.9 * vw)
        t = theta + 0.9 * vt
        p = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -500, 500)))
        d = (p - over) * weight[:, None]
        gw = x.summed(d.sum(1)) + ridge / len(x.rows) * (w + 0.9 * vw)
        vw, vt = 0.9 * vw - rate * gw, 0.9 * vt + rate * d.sum(0)
        w, theta = w + vw, np.maximum.accumulate(theta + vt)
    return w, theta


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs(text, ...) with severity double and toxic boolean; whole texts are read."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    rest = docs.drop("severity", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of.value
        for b in batches:
            s = [m.severity(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([v >= m.cut and bool(m.thresholds) for v in s], pa.bool_())], [*b.schema.names, "severity", "toxic"])

    schema = StructType([*rest.schema.fields]).add("severity", DoubleType()).add("toxic", BooleanType())
    return rest.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is rejected."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "severity", "toxic")
