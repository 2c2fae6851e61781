"""Documents for grounded search: chunks, embeddings, filtered top-k, confidence, versions."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as T
from ..functions import units as U
from .vectors import top_k  # noqa: F401  searches are part of this module's surface

CHUNK_SIZE, OVERLAP, LEAST_CHUNK, LEAST_BUDGET, DIMS = 900, 150, 25, 200, 64
#: Of embeddings: seeds of the two hashes, what a pair of neighbours counts, and the words that a task hashes together, of some characters each.
FNV_PRIME, SEEDS, PAIR, WORDS_AT_ONCE, WORD_LENGTH = 0x01000193, (0x811C9DC5, 0x9E3779B1), 0.6, 200_000, 6
WEIGHTS = (0.55, 0.15, 0.30)  # best similarity, agreement of the next two, coverage of the terms
# What is a heading, what ends a sentence and which abbreviations don't.
HEADING = r"^(?:(?P<marks>#{1,6})[^\S\n]+(?P<title>\S.*?)[^\S\n]*|(?P<number>\d+(?:\.\d+)*)[.)][^\S\n]+(?P<name>[A-Z].{2,80}))$"
SENTENCE_GAP = r"([.!?])\s+(?=[A-Z0-9])"
ABBREVIATION = r"\b(?:Rs|No)\.|\b[eE]\.[gG]\.|\b[iI]\.[eE]\.|\b[aA]pprox\."
IN_ABBREVIATIONS = ("Rs.", "No.", ".g.", ".G.", ".e.", ".E.", "pprox.")

_PLAIN, _EMBEDDING = pa.list_(pa.field("element", pa.float64(), False)), StructField("embedding", ArrayType(DoubleType(), False), False)
_HEADING, _GAP, _ABBREVIATION = re.compile(HEADING, re.MULTILINE), re.compile(SENTENCE_GAP), re.compile(ABBREVIATION)
_MARK = re.compile(r"\n[#\d]")  # of any heading


def split_sentences(text: str) -> list[str]:
    # what an abbreviation holds at least is looked for first, as most texts have none
    for x in ("\0", *IN_ABBREVIATIONS):
        if x in text:
            break
    else:
        return _split(text)
    return [p.replace("\0", ".").strip() for p in _split(_ABBREVIATION.sub(lambda m: m.group().replace(".", "\0"), text))]


def _split(text: str) -> list[str]:
    # parts and what ends them, in turn; only the whole text has blanks at its ends
    parts = _GAP.split(text.strip())
    return [*map(add, parts[:-1:2], parts[1::2]), *filter(None, parts[-1:])]


def sections(text: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(headings that lead here, body, offset) of what lies between a document's headings.

    Of the headings before, those lead here that are the last of a level above all later ones.
    """
    # most texts have no line that could be one, which is found out faster
    found = list(_HEADING.finditer(text)) if _MARK.search("\n" + text) else []
    ends = [m.start() for m in found[1:]] + [len(text)]
    out = [((), text[: found[0].start() if found else len(text)].strip(), 0)]
    leads: dict[int, str] = {}
    for m, end in zip(found, ends, strict=False):
        level = len(m["marks"]) if m["marks"] else m["number"].count(".") + 1
        leads = {at: h for at, h in leads.items() if at < level} | {level: m["title"] or f"{m['number']} {m['name']}".strip()}
        # a heading that is named twice on the way leads once, where it is nearest
        named = tuple(dict.fromkeys(reversed(leads.values())))[::-1]
        out.append((named, text[m.end() : end].strip(), m.start()))
    return [s for s in out if s[0] or s[1]]


class Lengths:
    """Running lengths of pieces that are joined by a glue."""

    def __init__(self, pieces: list[str], glue: str) -> None:
        self.pieces, self.glue = pieces, glue
        self.upto = [0, *accumulate(map(add, map(len, pieces), repeat(len(glue))))]

    def between(self, a: int, b: int) -> int:
        return self.upto[b] - self.upto[a] - len(self.glue)

    def join(self, a: int, b: int) -> str:
        return self.glue.join(self.pieces[a:b])

    def reach(self, a: int, room: int) -> int:
        """The end of the longest run from a on that fits; one piece at least."""
        return max(a + 1, bisect_right(self.upto, self.upto[a] + room + len(self.glue)) - 1)

    def last(self, b: int, room: int) -> int:
        """The beginning of the longest run up to b that fits; one piece at least."""
        return min(b - 1, bisect_left(self.upto, self.upto[b] - room - len(self.glue)))


def _ending(text: str, room: int) -> str:
    """Whole sentences from the end of a text that fit, one at least; none without room."""
    if room <= 0:
        return ""
    # the end is cut first, from a blank on, which tears no abbreviation; its first sentence may begin before it
    tail = text[max(0, text.rfind(" ", 0, max(0, len(text) - 2 * room))) :]
    s = Lengths(split_sentences(tail), " ")
    if len(tail) < len(text) and (len(s.pieces) < 2 or s.between(0, len(s.pieces)) <= room):
        s = Lengths(split_sentences(text), " ")
    return s.join(s.last(len(s.pieces), room), len(s.pieces)) if s.pieces else ""


def _units(body: str, room: int) -> list[str]:
    """Paragraphs, and runs of sentences of those that are too long."""
    out = []
    for p in filter(None, map(str.strip, body.split("\n\n"))):
        s, at = Lengths(split_sentences(p) if len(p) > room else [p], " "), 0
        while at < len(s.pieces):
            out.append(s.join(at, end := s.reach(at, room)))
            at = end
    return out


def chunks(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[str | None, str, int]]:
    """(section, text, start) of a document's chunks.

    A chunk is a run of units whose joined length fits, below the headings that lead to it.
    It begins with the last sentences of the one before, which don't count against the size.
    A run that would make a chunk of under 25 characters takes in the next unit, too. A text of
    headings only, or of tiny sections, is cut into windows of sentences.
    """
    overlap = min(overlap, size // 2)
    out: list[tuple[str | None, str, int]] = []
    for leads, body, start in sections(text):
        above = " > ".join(leads) + "\n" if leads else ""
        room = max(LEAST_BUDGET, size - len(above))
        units, at, carry = Lengths(_units(body, room), "\n\n"), 0, ""
        while at < len(units.pieces):
            before = carry + "\n\n" if carry else ""
            end = units.reach(at, room)
            while (short := len(above) + len(before) + units.between(at, end) < LEAST_CHUNK) and end < len(units.pieces):
                end += 1
            if short:
                break
            run = units.join(at, end)
            out.append((leads[-1] if leads else None, above + before + run, start))
            at, start, carry = end, start + len(before) + len(run), _ending(run, overlap)
    return out or _windows(text, size, overlap)


def _windows(text: str, size: int, overlap: int) -> list[tuple[None, str, int]]:
    """Whole sentences up to the size, each window with the end of the one before: for texts whose sections give no chunk."""
    s, out, at, end = Lengths(split_sentences(text), " "), [], 0, 0
    n = len(s.pieces)
    while len(text.strip()) >= LEAST_CHUNK and end < n:
        # at least one sentence that the window before doesn't have
        end = max(end + 1, s.reach(at, size))
        if end < n or s.between(at, end) >= LEAST_CHUNK:
            out.append((None, s.join(at, end), s.upto[at]))
        at = s.last(end, overlap) if overlap > 0 else end
    return out


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, keep: list[str] | None = None, dims: int | None = None) -> DataFrame:
    """(doc_id, keep..., chunk_index, section, chunk_text, char_start, token_estimate); a document is one row's work.

    keep names columns that each chunk has from its document. With dims chunks have their embeddings,
    too, as hashed_embedding() makes them, before their texts leave the task.
    """
    kept, known = ["doc_id", *(keep or [])], U.alphabet(docs.sparkSession) if dims else None
    made = {"chunk_index": pa.int32(), "section": pa.string(), "chunk_text": pa.string(), "char_start": pa.int32(), "token_estimate": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                found = [chunks(text or "", size, overlap) for text in b.column("text").to_pylist()]
                rows = [(k, s, t, at, math.ceil(len(t) / 4)) for each in found for k, (s, t, at) in enumerate(each)]
                of = pa.array(np.repeat(np.arange(len(found)), [len(each) for each in found]), pa.int64())
                cols = list(zip(*rows, strict=True)) or [()] * len(made)
                arrays = [*(b.column(c).take(of) for c in kept), *(pa.array(list(c), t) for c, t in zip(cols, made.values(), strict=True))]
                if dims:
                    arrays.append(_embedded_texts(list(cols[2]), known, dims))
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *made, *(["embedding"] if dims else [])])

    rows = docs.select(*kept, "text")
    schema = StructType([rows.schema[c] for c in kept])
    for name, kind in (("chunk_index", "integer"), ("section", "string"), ("chunk_text", "string"), ("char_start", "integer"), ("token_estimate", "integer")):
        schema.add(name, kind)
    if dims:
        schema.add(_EMBEDDING)
    return rows.mapInArrow(run, schema)


def fnv1a(text: str, seed: int = 0x811C9DC5) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    raw = text.encode("utf-16-le", "surrogatepass")
    h = seed
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * FNV_PRIME) & 0xFFFFFFFF
    return h


def _hashed(h: np.ndarray, units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The states h (a row a seed, a column a word) after each word's units; all words go on by one unit at a time, the longest first."""
    # short numbers are sorted by their digits
    order = np.argsort(-(size.astype(np.int16) if size.max(initial=0) < 1 << 15 else size), kind="stable")
    out, at, size = h.take(order, 1), start.take(order), size.take(order)
    live = np.searchsorted(-size, -np.arange(size.max(initial=0)))  # words with more than i units
    for i, n in enumerate(live):
        if n < 8:  # the rest of a few long words
            for j in range(n):
                for seed, state in enumerate(out[:, j].tolist()):
                    for u in units[at[j] : at[j] + size[j] - i].tolist():
                        state = ((state ^ u) * FNV_PRIME) & 0xFFFFFFFF
                    out[seed, j] = state
            break
        u = units.take(at[:n])
        for state in out[:, :n]:
            state ^= u
            state *= np.uint32(FNV_PRIME)
        at += 1
    back = np.empty_like(out)
    back[:, order] = out
    return back


def _met(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's features how many there are, at the first occurrence (0 at others), and which occurrences aren't the only ones."""
    n = len(row)
    bits = n.bit_length()
    key = np.sort((row * (feature.max(initial=0) + 1) + feature << bits) + np.arange(n))
    at, group = key & (1 << bits) - 1, key >> bits
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    many = np.diff(begin, append=n)
    count, again = np.zeros(n, np.int64), np.zeros(n, bool)
    count[at[begin]] = many
    again[at[np.repeat(many > 1, many)]] = True
    return count, again


def _weights(count: np.ndarray, one: float) -> np.ndarray:
    """1 + ln of so many times what one counts, added up; 0 of none."""
    some = np.flatnonzero(np.bincount(count))
    some, sums = some[some > 0], np.cumsum(np.full(count.max(initial=0), one))
    table = np.zeros(len(sums) + 1)
    table[some] = [1 + math.log(sums[c - 1]) for c in some]
    return table[count]


def _vectors(words: U.Words, n: int, dims: int) -> np.ndarray:
    """The embeddings, not yet of length 1, of n rows of words; distinct stems are hashed once, and pairs go on from the first stem and its underscore."""
    word, known = U.distinct(U.stemmed(words))
    units = known.units.astype(np.uint32)
    h = _hashed(np.repeat(np.array(SEEDS, np.uint32)[:, None], len(known.start), axis=1), units, known.start, known.size)
    first = np.flatnonzero(words.row[1:] == words.row[:-1])  # of pairs of neighbours
    left, right = word[first], word[first + 1]
    after = (h ^ np.uint32(ord("_"))) * np.uint32(FNV_PRIME)
    pairs = _hashed(after.take(left, 1), units, known.start.take(right), known.size.take(right))
    count, again = _met(words.row, word)
    # only pairs of words that come again can come again
    twice, of_pairs = np.flatnonzero(again[first] & again[first + 1]), np.ones(len(first), np.int64)
    _, pair = np.unique(left[twice] * len(known.start) + right[twice], return_inverse=True)
    of_pairs[twice] = _met(words.row[first[twice]], pair)[0]
    # in the order of the text, a word and then its pair, each in two buckets; all but first occurrences add nothing
    into, value = np.zeros((len(word), 4), np.int64), np.zeros((len(word), 4))
    row, signs, by = words.row * dims, np.array([1.0, -1.0]), (_weights(count, 1.0), _weights(of_pairs, PAIR))
    for k in range(len(SEEDS)):
        bucket, sign = h[k] % np.uint32(dims), signs.take(h[k] >> np.uint32(16) & np.uint32(1))
        into[:, k], value[:, k] = row + bucket.take(word), sign.take(word) * by[0]
        into[first, 2 + k], value[first, 2 + k] = row.take(first) + pairs[k] % np.uint32(dims), signs.take(pairs[k] >> np.uint32(16) & np.uint32(1)) * by[1]
    return np.bincount(into.ravel(), value.ravel(), n * dims).reshape(n, dims)


def _embedded(words: pa.ListArray, dims: int) -> np.ndarray:
    """The embeddings, not yet of length 1, of rows of words."""
    return _vectors(U.listed(words), len(words), dims)


def _embedded_texts(texts: list[str], known: U.Alphabet, dims: int) -> pa.ListArray:
    """The embeddings of texts, some of them at a time."""
    ends, lo, made = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), 0, [np.zeros((0, dims))]
    while lo < len(texts):
        # rows up to some length, one at least
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS_AT_ONCE * WORD_LENGTH, "right")))
        v = _vectors(U.cut(texts[lo:hi], known), hi - lo, dims)
        length = np.array([math.sqrt(sum(each)) or 1.0 for each in (v * v).tolist()])
        made.append(v / length[:, None])
        lo = hi
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), pa.array(np.concatenate(made).ravel()), type=_PLAIN)


def hashed_embedding(docs: DataFrame, dims: int = DIMS, text: str = "text") -> DataFrame:
    """docs, without its text where that is the column text, and embedding: words count 1, pairs of neighbours 0.6; 1 + ln(count) in two signed buckets; length 1.

    A task cuts, stems and hashes the words of some rows at a time, as arrays.
    """
    kept = [c for c in docs.columns if c not in ("text", "embedding")]
    read, known = docs.select(*kept, F.coalesce(text, F.lit("")).alias("_text")), U.alphabet(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                b = whole.slice(lo, 2_000)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), _embedded_texts(b.column("_text").to_pylist(), known, dims)], [*kept, "embedding"])

    return read.mapInArrow(run, StructType([*(f for f in read.schema if f.name != "_text"), _EMBEDDING]))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity over the components both have; 0 if either is a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def confidence(ranked: DataFrame, coverage: Column | None = None) -> DataFrame:
    """(query_id, best, agreement, confidence) from top_k(): the best, the mean of ranks 2 and 3, coverage."""
    got = ranked.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("best"),
        F.coalesce(F.avg(F.when(F.col("rank").between(2, 3), F.col("similarity"))), F.lit(0.0)).alias("agreement"),
        F.max(coverage if coverage is not None else F.lit(0.0)).alias("coverage"),
    )
    mixed = sum((w * F.col(c) for w, c in zip(WEIGHTS, ("best", "agreement", "coverage"), strict=True)), F.lit(0.0))
    return got.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), 3))


def versions(arrivals: DataFrame, keys: list[str], order: str, digest: str = "hash", width: int = 10_000) -> DataFrame:
    """Rows whose content differs from the one before, numbered; the last is active, others superseded.

    order is a whole number. A key's rows are taken by stretches of `width` of it: what a
    stretch knows of its neighbours is one row each (the last content before it, how many
    versions lie before it, whether any comes after), so that no task holds all of a key.
    """
    stretch = F.floor(F.col(order) / width).alias("_at")
    rows = arrivals.withColumn("_at", stretch)
    # keys may be null, and are joined as such
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*keys, "_at"]])
    over = Window.partitionBy(*keys).orderBy("_at")
    ends = rows.groupBy(*keys, "_at").agg(F.max_by(F.struct(digest), order).alias("_last"))
    ends = ends.withColumn("_prior", F.lag("_last").over(over)).drop("_last")
    within = Window.partitionBy(*keys, "_at").orderBy(order)
    both = rows.alias("r").join(ends.alias("e"), same("r", "e")).select("r.*", "e._prior")
    was = F.coalesce(F.lag(F.struct(digest)).over(within), F.col("_prior"))
    changed = both.withColumn("_was", was).where(F.col("_was").isNull() | ~F.col(f"_was.{digest}").eqNullSafe(F.col(digest))).drop("_was", "_prior")
    counts = changed.groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(over) - F.col("_n")).withColumn("_more", F.lead("_n").over(over).isNotNull()).drop("_n")
    numbered = changed.withColumn("_k", F.row_number().over(within)).withColumn("_after", F.lead(order).over(within).isNotNull())
    got = numbered.alias("r").join(counts.alias("e"), same("r", "e"))
    active = ~(F.col("_after") | F.col("_more"))
    return got.select(*[f"r.{c}" for c in arrivals.columns], (F.col("_before") + F.col("_k")).cast("int").alias("version"), F.when(active, "active").otherwise("superseded").alias("status"))


def extractive_answer(chunks_: DataFrame, terms: Column, k: int = 3) -> DataFrame:
    """(query_id, rank, sentence, score): sentences by shared terms times (0.5 + similarity), each once."""
    each = chunks_.select("query_id", "similarity", F.explode(T.sentences(F.col("chunk_text"))).alias("sentence"), terms.alias("asked"))
    shared = F.size(F.array_intersect(T.terms(F.col("sentence")), F.col("asked")))
    scored = each.withColumn("score", F.round(shared * (0.5 + F.col("similarity")), 6)).where("score > 0").groupBy("query_id", "sentence").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "sentence"))).where(F.col("rank") <= k)


def repeated_lines(pages: DataFrame, keys: list[str], page: str, share: float = 0.6) -> DataFrame:
    """(keys, line): lines of 8 to 120 characters on at least that share of three pages or more."""
    n = pages.groupBy(*keys).agg(F.countDistinct(page).alias("_pages")).where("_pages >= 3")
    lines = pages.select(*keys, page, F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line")).where(F.length("line").between(8, 120)).distinct()
    counts = lines.groupBy(*keys, "line").agg(F.count("*").alias("n"))
    return counts.join(n, keys).where(F.col("n") >= F.col("_pages") * share).select(*keys, "line", "n")
