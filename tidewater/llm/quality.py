"""Quality rules: a decision list over statistics of a text, learned from labelled documents.

A rule is a conjunction of thresholds (symbol_share > 0.02 and n_words > 31), and says that a
text is of low quality. Rules are learned one after the other from what passes the base rules and
the ones before don't cover (sequential covering): a rule grows on two thirds of the rows, by the threshold with the
highest information gain, until it covers low quality only; it is pruned on the other third,
by dropping its last thresholds as long as that doesn't make it worse; and it joins the list
if it is precise there. The list is a Spark expression, CASE WHEN ... THEN false ... ELSE true,
so that judging a document is generated code over its statistics.

Statistics are made in one pass over each whole text: a count of its bytes by value, its words
and its lines. Repeated windows of eight words are found exactly, by numbering words, then
pairs of numbers, pairs of those, and so on; memory is some numbers a word. Nothing is shuffled
but the bounded sample.

Nulls and edge cases: a null text has no word, line or character, so it fails the base rules;
so does an empty one; repeated rows, and rows with equal doc_id, are judged each, and all take
its label in the sample (0 if labels disagree); a null doc_id has no label; labels other than 0
and 1 are left out; without labelled rows of both kinds there is no rule, and what passes the
base rules is kept; a value equal to a threshold lies below it; very long texts are read whole;
an empty table gives an empty result; other columns stay, but for those that the operator makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from .common import load, stash

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may ask, besides n_words: shares of a text's words, characters and lines.
SHARES = ("mean_word", "symbol_share", "upper_share", "digit_share", "mark_share", "end_share", "repeat_share", "echo_share", "dup_line_share", "line_words")
ASKED = ("n_words", *SHARES)
MADE = (*COUNTS, *SHARES, "base_failed", "kept")


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


SPACES, SYMBOLS, UPPER, DIGITS, MARKS, STOPS = map(_bytes, (" \t\n\v\f\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?;:,.\"'()[]{}=_~^@/\\+-", ".!?"))


def repeated(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many places lie in windows of `width` (a power of two) numbers that come twice or more."""
    at, reach = ids, 1
    while reach < width:
        if len(at) <= reach:
            return 0
        pairs = at[:-reach].astype(np.int64) * (int(at.max()) + 1) + at[reach:]
        kinds, at = np.unique(pairs, return_inverse=True)
        reach *= 2
        if len(kinds) == len(at):
            return 0  # no shorter window comes twice, so no longer one does
    hits = np.flatnonzero(np.bincount(at)[at] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[hits] += 1
    edges[hits + width] -= 1  # each window starts once
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[float, ...]:
    """COUNTS, then SHARES, of a text in UTF-8."""
    text = text or b""
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()  # of bytes: at ASCII white space only
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n, chars = len(words), int(of[:0x80].sum() + of[0xC0:].sum() - of[SPACES].sum())
    dup, again = len(lines) - len(set(lines)), repeated(ids)
    per_char, per_word, per_line = 1 / max(1, chars), 1 / max(1, n), 1 / max(1, len(lines))
    shares = chars * per_word, of[SYMBOLS].sum() * per_char, of[UPPER].sum() * per_char, of[DIGITS].sum() * per_char, of[MARKS].sum() * per_char, of[STOPS].sum() * per_word, again * per_word, (ids[1:] == ids[:-1]).sum() * per_word, dup * per_line, n * per_line
    return (n, chars, int(of[SYMBOLS].sum()), dup, again, *map(float, shares))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with COUNTS and SHARES in place of the text."""
    kept = [c for c in docs.columns if c not in (*MADE, "text")]
    schema = StructType([*(docs.schema[c] for c in kept)])
    for c in (*COUNTS, *SHARES):
        schema.add(c, LongType() if c in COUNTS else DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(measure(t.as_py()) for t in b.column("text")), strict=True)) or [()] * len(COUNTS + SHARES)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, pa.int64() if name in COUNTS else pa.float64()) for c, name in zip(cols, COUNTS + SHARES, strict=True))], [*kept, *COUNTS, *SHARES])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (statistic, "above" or "upto", threshold)."""

    asks: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        held = np.ones(len(x), bool)
        for name, way, at in self.asks:
            v = x[:, ASKED.index(name)]
            held &= v > at if way == "above" else v <= at
        return held

    def sql(self) -> str:
        return " AND ".join(f"{name} {'>' if way == 'above' else '<='} {at!r}D" for name, way, at in self.asks)


@dataclass
class DecisionList:
    """Rules of low quality, in order; what none of them covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def sql(self) -> str:
        """The list as a Spark expression over the statistics: true if the text is kept."""
        return " ".join(["CASE", *(f"WHEN {r.sql()} THEN false" for r in self.rules), "ELSE true END"]) if self.rules else "true"


def _best_ask(x: np.ndarray, low: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The threshold with the highest gain: low rows it keeps times the bits it saves for each."""
    p0, n0 = weight[low].sum(), weight[~low].sum()
    base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for j, name in enumerate(ASKED):
        order = np.argsort(x[:, j], kind="stable")
        v, w, is_low = x[order, j], weight[order], low[order]
        ends = np.flatnonzero(np.diff(v) > 0)  # between different values
        upto_p, upto_n = np.cumsum(w * is_low)[ends], np.cumsum(w * ~is_low)[ends]
        for way, p, n in (("upto", upto_p, upto_n), ("above", p0 - upto_p, n0 - upto_n)):
            with np.errstate(all="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                k = ends[gain.argmax()]
                best = float(gain.max()), (name, way, round(float((v[k] + v[k + 1]) / 2), 6) if round(float((v[k] + v[k + 1]) / 2), 6) < v[k + 1] else float(v[k]))
    return best


def grow(x: np.ndarray, low: np.ndarray, weight: np.ndarray, most_asks: int) -> Rule:
    """Thresholds one by one, until the rule covers low rows only."""
    rule, held = Rule(), np.ones(len(x), bool)
    while len(rule.asks) < most_asks and (held & low).any() and (held & ~low).any():
        gain, ask = _best_ask(x[held], low[held], weight[held])
        if ask is None:
            break
        rule.asks.append(ask)
        held = rule.covers(x)
    return rule


def prune(rule: Rule, x: np.ndarray, low: np.ndarray, weight: np.ndarray) -> tuple[Rule, float, float]:
    """The shortest of the best beginnings of a rule on rows it hasn't grown on, its precision there and the weight of low rows it covers."""
    best = Rule(), -1.0, 0.0
    for k in range(1, len(rule.asks) + 1):
        part = Rule(rule.asks[:k])
        held = part.covers(x)
        p, n = weight[held & low].sum(), weight[held & ~low].sum()
        precision = (p + 0.5) / (p + n + 1)
        if p and precision > best[1] + 1e-9:
            best = part, precision, p
    return best


def learn(x: np.ndarray, low: np.ndarray, weight: np.ndarray, least_precision: float, least_covered: float, most_rules: int, most_asks: int) -> DecisionList:
    """Sequential covering of the low rows of x (ASKED columns)."""
    found, left = DecisionList(), np.ones(len(x), bool)
    aside = np.arange(len(x)) % 3 == 2
    all_low = weight[low & aside].sum()
    while len(found.rules) < most_rules and (left & low & ~aside).any() and (left & low & aside).any():
        g, p = left & ~aside, left & aside
        rule, precision, covered = prune(grow(x[g], low[g], weight[g], most_asks), x[p], low[p], weight[p])
        if not rule.asks or precision < least_precision or covered < least_covered * all_low:
            break
        found.rules.append(rule)
        left &= ~rule.covers(x)
    return found


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, least_precision: float = 0.9, least_covered: float = 0.005, most_rules: int = 24, most_asks: int = 6) -> DecisionList:
    """Learns from a bounded sample of labels(doc_id, quality), 0 for low.

    max_labelled bounds the sample: half of it low at most, the rest not, in the order of a
    hash of doc_id; rows of a class weigh as much as there are of it. Each sampled text is
    read whole, on the executors; the driver gets the statistics, a dozen numbers a text.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("doc_id is not null and _quality in (0, 1)").groupBy("doc_id").agg(F.min("_quality").alias("_quality"))
    marked = stash(marked, "quality_labels")
    size = {r["_quality"]: r.n for r in marked.groupBy("_quality").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return DecisionList()
    some = [marked.where(F.col("_quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled // 2) for k in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    # rows that share a doc_id: one of them, so that the sample stays bounded
    passed = statistics(chosen).where(~base_failed())  # what fails the base rules needs no others
    rows = passed.groupBy("doc_id", "_quality").agg(F.min(F.struct(*ASKED)).alias("_x")).collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id))  # a fixed order unlike that of ids
    low = np.array([r["_quality"] == 0 for r in rows], bool)
    if low.all() or not low.any():
        return DecisionList()
    weight = np.where(low, size[0] / low.sum(), size[1] / (~low).sum()) / (size[0] + size[1]) * len(rows)
    return learn(np.array([list(r["_x"]) for r in rows], float), low, weight, least_precision, least_covered, most_rules, most_asks)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with the statistics in place of the text, base_failed and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.expr(rules.sql()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, load(spark, sf_dir, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of judge(): the counts and the base rules."""
    return query(spark, sf_dir).drop("kept")


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT n, i, ws[i:i + 7] AS win FROM (SELECT n, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
t AS (SELECT n, i FROM p QUALIFY count(*) OVER (PARTITION BY n, win) > 1),
r AS (SELECT n, count(DISTINCT j) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 8)) AS j FROM t) GROUP BY n),
s AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (n))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
"""
