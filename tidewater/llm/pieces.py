"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton runs once over a stretch of text; at every position its output links give
all pieces that end there, and each of them may improve the best way to that position.
For unigram models the best way is the one with the highest sum of scores (Viterbi). BPE
models have no such sum: a way is right there if every two neighbours would stay two pieces
when merged by rank, so at each position the piece is kept that may follow the best way to
its own beginning. The result is the one that merging by rank gives.

Pieces don't reach over a word's beginning, so texts are cut there and words that come
again are looked up.

Nulls and edge cases: a null text is an empty text and has no pieces; very long texts are
encoded whole, a word of n characters in about n steps; of ways with equal sums the one that
is found first stays (the longest last piece), of equal ranks the leftmost pair joins first;
characters without a piece become byte pieces, or the unknown piece in a model without;
decoding gives the normalized text back (a U+2581 in it, and what the model's normalizer
changes, don't come back); repeated rows are encoded each; an empty table gives an empty
result; the result has the named columns only, whatever others the table has.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words, and pairs of pieces, that a worker remembers at a time.
KEPT_WORDS = 600_000
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def model_type(proto: bytes) -> int:
    """UNIGRAM or BPE, from the model's trainer settings."""
    return next((int(v) for k, spec in _fields(proto) if k == 2 for f, v in _fields(spec) if f == 3), UNIGRAM)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """Encodes and decodes with one model, given as its bytes."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        self.kind, self.unk = model_type(proto), self.sp.unk_id()
        self.piece = [self.sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.sp.is_byte(i)}
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {i: self.sp.get_score(i) for i in plain}
        self.low = min(self.score.values(), default=0.0) - 10
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        if self.id:
            self.automaton.make_automaton()
        # what a piece stands for in the text
        self.text = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else " ⁇ ".encode() if self.sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        #: ids of the words met, by the word, and of those after one space by what follows it
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.lone: dict[int, bool] = {}
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.rank = {p: self.score[i] for p, i in self.id.items()}
        self.size = [len(p) for p in self.piece]

    def merged(self, text: str) -> list[str]:
        """The text's pieces by definition: of all neighbours that join to a piece, the best joins first, the leftmost of equals."""
        part, rank, n = list(text), self.rank, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if after[i] < n and (got := rank.get(s := part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (-got, i, s))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = after[i]
            if j >= n or not part[i] or part[i] + part[j] != s:
                continue  # one of the two has joined another since
            part[i], part[j], after[i] = s, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _stay(self, a: int, b: int) -> bool:
        """Whether two pieces stay two when their text is merged."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > KEPT_WORDS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return got

    def _whole(self, s: str) -> list[int]:
        """Ids of a text all of whose characters are pieces, for models that merge by rank."""
        last: list[int | None] = [None] * (len(s) + 1)
        pairs, stay, alone, size = self.pairs, self._stay, self._alone, self.size
        for end, (length, i) in self.automaton.iter(s):
            end += 1
            # longer pieces come first, and only one of those that end here can follow
            if last[end] is None:
                if length == end:
                    if alone(i):
                        last[end] = i
                elif (before := last[end - length]) is not None:
                    # two that stay two stay one each, too
                    ok = pairs.get((before, i))
                    if stay(before, i) if ok is None else ok:
                        last[end] = i
        out, end = [], len(s)
        while end:
            i = last[end]
            out.append(i)
            end -= size[i]
        out.reverse()
        return out

    def _bytes(self, c: str) -> list[int]:
        return [self.byte[x] for x in c.encode("utf-8", "surrogatepass")] if len(self.byte) == 256 else [self.unk]

    def stretch(self, s: str) -> list[int]:
        """Ids of normalized text: one pass of the automaton, relaxing at each end of a piece."""
        if self.kind == BPE and self.id.keys() >= set(s):
            return self._whole(s)
        n = len(s)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # start and id; id -1: a character without a piece
        whole = self.kind == BPE
        at = 1  # ends before this are done
        for end, (length, i) in self.automaton.iter(s):
            end += 1
            while at < end:
                self._unknown(s, at, best, back)
                at += 1
            start = end - length
            if best[start] == float("-inf"):
                continue
            if whole:
                # longer pieces come first, and only one of those that end here can follow
                if back[end] is None and (length == 1 or self._alone(i)) and (start == 0 or back[start][1] < 0 or self._stay(back[start][1], i)):
                    best[end], back[end] = 0.0, (start, i)
            elif best[start] + self.score[i] > best[end]:
                best[end], back[end] = best[start] + self.score[i], (start, i)
        while at <= n:
            self._unknown(s, at, best, back)
            at += 1
        out: list[list[int]] = []
        end = n
        while end:
            start, i = back[end]
            out.append([i] if i >= 0 else self._bytes(s[start:end]))
            end = start
        return [i for ids in reversed(out) for i in ids]

    def _alone(self, i: int) -> bool:
        """Whether merging by rank gives this piece for its own text."""
        got = self.lone.get(i)
        if got is None:
            got = self.lone[i] = len(self.merged(self.piece[i])) == 1
        return got

    def _unknown(self, s: str, end: int, best: list[float], back: list) -> None:
        """A character without a piece is a piece of its own; with one, this is never better."""
        if back[end] is None and best[end - 1] > float("-inf") and s[end - 1] not in self.id:
            best[end], back[end] = best[end - 1] + (self.low if self.kind != BPE else 0.0), (end - 1, -1)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        s = self.sp.normalize(text) if text else ""
        if not s:
            return b""
        if self.crossing:
            return _packed(self.stretch(s))
        out: list[bytes] = []
        words, spaced = self.words, self.spaced
        for run in self._runs(s):
            first, *rest = run.split(SPACE)
            if first:
                out.append(words.get(first) or self._word(first, words))
            spaces = 0
            for w in rest:
                # most words come after one space, and are looked up without it
                if not w:
                    spaces += 1
                elif spaces:
                    w, spaces = SPACE * (spaces + 1) + w, 0
                    out.append(words.get(w) or self._word(w, words))
                else:
                    out.append(spaced.get(w) or self._word(w, spaced, SPACE))
            if spaces:
                out.append(self._word(SPACE * spaces, words))
        return b"".join(out)

    def _runs(self, s: str) -> list[str]:
        """The text cut around characters that no piece of a model that merges by rank holds."""
        odd = set(s) - self.chars if self.kind == BPE else None
        if not odd:
            return [s]
        mark = next(c for c in map(chr, range(1, 0x110000)) if c not in odd and c not in self.chars)
        for c in odd:
            s = s.replace(c, mark + c + mark)
        return [x for x in s.split(mark) if x]

    def _word(self, w: str, known: dict[str, bytes], before: str = "") -> bytes:
        """The ids of a word, which is remembered."""
        if len(known) >= KEPT_WORDS:
            known.clear()
        s = before + w
        if self.kind != BPE:
            ids = self.stretch(s)
        elif s[0] not in self.id:
            ids = self._bytes(s)
        elif s.startswith(SPACE * 2):
            # of several spaces any two may join, with equal rank: there the order of merging decides
            ids = [self.id[p] for p in self.merged(s)]
        else:
            ids = self._whole(s)
        got = known[w] = _packed(ids)
        return got

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text; the space that the model puts first is taken off."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and ids and self.piece[ids[0]].startswith(SPACE) else text


_CODECS: dict[bytes, Codec] = {}


def _codec(proto: bytes) -> Codec:
    """The worker's codec for a model: tasks that follow each other share what it remembers."""
    key = hashlib.blake2b(proto).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(proto)
    return _CODECS[key]


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a model's file, some MB


def encode(docs: DataFrame, path: str = MODEL, check: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces long) of every text, with check also restored boolean.

    restored: decoding the ids gives the text back.
    """
    sent = _model(docs.sparkSession, path)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                coded = [codec.encode_bytes(t) for t in texts]
                sizes = np.array([len(c) // 4 for c in coded], np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                cols = [part.column("doc_id"), ids, pa.array(sizes.astype(np.int64))]
                if check:
                    cols.append(pa.array([codec.decode(np.frombuffer(c, "<i4").tolist()) == t for c, t in zip(coded, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_pieces", "restored"][: len(cols)])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long" + ", restored boolean" * check)


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    sent = _model(coded.sparkSession, path)
    rows = coded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), check=True)
