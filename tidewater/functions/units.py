"""Words of many texts at once, as arrays of UTF-16 units: what text.words() cuts and text.stems() makes of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import _DOUBLES, _ES, LETTERS, SHORTEST_STEM, STOP_WORDS, SUFFIXES

#: Stop words as eight bytes each, ascending; a first byte is the lowest.
_STOPS = np.sort(np.array([int.from_bytes(w.encode("ascii"), "little") for w in STOP_WORDS], np.uint64))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONGEST_STOP = max(map(len, STOP_WORDS))  # eight at most
#: Stands for units whose lower case depends on others; no character.
WHOLE = 0xFFFF


@dataclass
class Words:
    """Words in a buffer of units, none at its ends and no two without a unit between them; row has the text that each is from."""

    units: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray


@dataclass
class Alphabet:
    """To the JVM of Spark: each UTF-16 unit's lower case, WHOLE if that takes the whole text, and whether a code point is a letter or digit."""

    lower: np.ndarray
    letter: np.ndarray


@lru_cache(1)
def alphabet(spark: SparkSession) -> Alphabet:
    """Asks Spark for every code point, so that arrays hold what its columns would."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    asked = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).select("id", char.rlike(f"^[{LETTERS}]$").alias("letter"), F.lower(char).alias("low"), char.alias("char"))
    found = asked.where("letter or low <> char").select("id", "letter", "low").toArrow()
    at = found.column("id").to_numpy()
    out = Alphabet(np.arange(0x10000, dtype=np.uint16), np.zeros(0x110000, bool))
    out.lower[0xD800:0xE000] = out.lower[ord("\u03a3")] = WHOLE  # halves of characters, and a sigma that may end a word
    out.letter[at[found.column("letter").to_numpy()]] = True
    for i, low in zip(at[at < 0x10000].tolist(), found.column("low").to_pylist(), strict=False):
        if out.lower[i] != WHOLE:
            out.lower[i] = ord(low) if len(low) == 1 else WHOLE
    return out


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' units, a zero before each and one behind, and the places of those zeros."""
    units = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-16-le", "surrogatepass"), "<u2")
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if size.sum() + len(texts) + 1 < len(units):  # some characters are two units
        size = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
    return units, np.concatenate([[0], np.cumsum(size + 1)])


def _characters(w: Words) -> np.ndarray:
    """Lengths of words in characters."""
    low = (w.units & 0xFC00) == 0xDC00
    if not low.any():
        return w.size
    upto = np.concatenate([[0], np.cumsum(low)])
    return w.size - (upto[w.start + w.size] - upto[w.start])


def cut(texts: list[str], known: Alphabet) -> Words:
    """What words() makes of texts: in lower case, runs of letters and digits of more than one character that aren't stop words."""
    units, zeros = _buffer(texts)
    low = known.lower[units]
    if (low == WHOLE).any():
        units, zeros = _buffer([t.lower() for t in texts])
        low = known.lower[units]
        low = np.where(low == WHOLE, units, low)
    units, inside = low, known.letter[low]
    high = np.flatnonzero((units[:-1] & 0xFC00) == 0xD800)
    high = high[(units[high + 1] & 0xFC00) == 0xDC00]
    if len(high):
        inside[high] = inside[high + 1] = known.letter[0x10000 + ((units[high].astype(np.int64) & 0x3FF) << 10) + (units[high + 1] & 0x3FF)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start = edges[::2]
    w = Words(units, start, edges[1::2] - start, np.searchsorted(start, zeros))
    row = np.repeat(np.arange(len(texts)), np.diff(w.row))
    narrow = np.concatenate([np.minimum(units, 255).astype(np.uint8), np.zeros(8, np.uint8)])
    short = np.flatnonzero(w.size <= _LONGEST_STOP)
    packed = np.ndarray(len(units), "<u8", narrow, strides=(1,))[start[short]] & _MASKS[w.size[short]]
    kept = _characters(w) > 1
    kept[short[_STOPS[np.minimum(np.searchsorted(_STOPS, packed), len(_STOPS) - 1)] == packed]] = False
    return Words(units, start[kept], w.size[kept], row[kept])


def listed(words: pa.ListArray) -> Words:
    """Words that come as lists."""
    units, zeros = _buffer(words.flatten().to_pylist())
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    return Words(units, zeros[:-1] + 1, np.diff(zeros) - 1, np.repeat(np.arange(len(words)), sizes))


def stemmed(w: Words) -> Words:
    """What stem_of() makes of each word: rules go over the words that end in their last letter, all at once."""
    units, end, chars = w.units.copy(), w.start + w.size, _characters(w).copy()

    def ending(at: np.ndarray, suffix: str) -> np.ndarray:
        """Which of some words end so; what is before a word is no letter."""
        for k, c in enumerate(reversed(suffix), 1):
            at = at[units[end[at] - k] == ord(c)]
        return at

    def shorten(at: np.ndarray, by: int) -> None:
        end[at] -= by
        chars[at] -= by

    last = units[end - 1]
    open_ = {c: np.flatnonzero(last == ord(c)) for c in {s[-1] for s, _ in SUFFIXES}}
    for s, put in SUFFIXES:
        at = ending(open_[s[-1]], s)
        at = at[chars[at] - len(s) + len(put) >= SHORTEST_STEM]
        open_[s[-1]] = np.setdiff1d(open_[s[-1]], at, assume_unique=True)
        shorten(at, len(s) - len(put))
        for k, c in enumerate(reversed(put), 1):
            units[end[at] - k] = ord(c)
    at = ending(np.flatnonzero(chars > 6), "ate")
    shorten(at, 3)
    long = np.flatnonzero(chars > SHORTEST_STEM)
    last = units[end[long] - 1]
    twice = long[last == units[end[long] - 2]]
    shorten(np.concatenate([ending(twice, s) for s in _DOUBLES]), 1)
    long = np.flatnonzero(chars > SHORTEST_STEM)
    at = ending(long, "s")
    two = np.concatenate([ending(at, s) for s in _ES])
    one = np.setdiff1d(np.setdiff1d(at, two, assume_unique=True), ending(at, "ss"), assume_unique=True)
    shorten(two, 2)
    shorten(one, 1)
    return Words(units, w.start, end - w.start, w.row)


def distinct(w: Words) -> tuple[np.ndarray, Words]:
    """Each word's number, and the words that the numbers stand for, without rows."""
    step = np.zeros(len(w.units) + 1, np.int8)
    step[w.start] += 1
    step[w.start + w.size] -= 1
    data = w.units[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    ends = np.concatenate([[0], np.cumsum(w.size)]) * 2
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    known = found.dictionary
    if not len(known):
        return np.zeros(0, np.int64), Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1] // 2
    units = np.frombuffer(known.buffers()[2], "<u2")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), Words(units, at[:-1], np.diff(at), at[:0])
