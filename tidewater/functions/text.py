"""Text columns: cleaning, sentences, terms, stems, claims, markup."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these words and forms.
STOP_WORDS = (
    "a an the is are was were be been being am do does did have has had i you he she it we they me my your "
    "this that these those to of in on at for with and or but if can could will would should please want need "
    "from by as so not no yes about there their what how"
).split()
#: (suffix, replacement), the first that fits wins; what is left has four characters at least.
SUFFIXES = (
    ("ationally", "ate"), ("ation", "ate"), ("isation", "ise"), ("ization", "ize"), ("fulness", "ful"), ("ements", "ement"), ("ement", ""), ("ments", "ment"),
    ("ment", ""), ("ness", ""), ("ingly", ""), ("edly", ""), ("ing", ""), ("ies", "y"), ("ied", "y"), ("ed", ""),
)
SHORTEST_STEM = 4
_ENDINGS, _DOUBLES, _ES = tuple(s for s, _ in SUFFIXES), tuple(2 * c for c in "bdfglmnprt"), ("ses", "xes", "zes", "ches", "shes")
#: What words consist of: letters and digits.
LETTERS = r"\p{L}\p{N}"
#: Numbers that carry meaning in an answer.
CLAIM = r"(?i)(?:rs\.?\s?)?\b\d{1,3}(?:,\d{3})+\b|\b\d+\s*(?:days|day|weeks|week|months|month|years|year|%|percent)\b|\brs\.?\s?\d+\b"


def contains_any(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether one of the terms is in the text, also inside a word: one expression, however many terms."""
    return text.rlike("|".join(map(re.escape, terms))) if terms else F.lit(False)


def count_terms(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """How many of the terms are in the text."""
    total = F.lit(0)
    for t in terms:
        total = total + text.contains(t).cast("int")
    return total


def normalise(text: Column) -> Column:
    """Lower case; anything but letters, digits and spaces becomes a space; runs of spaces are one."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{LETTERS}]+", " "))


def _suffix(w: Column) -> Column:
    cut = w
    for suffix, put in reversed(SUFFIXES):
        keep = F.length(w) - len(suffix) + len(put)
        cut = F.when(w.endswith(suffix) & (keep >= SHORTEST_STEM), F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(put))).otherwise(cut)
    return cut


def _ate(w: Column) -> Column:
    return F.when(w.endswith("ate") & (F.length(w) > 6), F.substring(w, F.lit(1), F.length(w) - 3)).otherwise(w)


def _doubled(w: Column) -> Column:
    return F.when(w.rlike(r"(bb|dd|ff|gg|ll|mm|nn|pp|rr|tt)$") & (F.length(w) > SHORTEST_STEM), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def _plural(w: Column) -> Column:
    long = F.length(w) > SHORTEST_STEM
    return F.when(long & w.rlike("(s|x|z|ch|sh)es$"), F.substring(w, F.lit(1), F.length(w) - 2)).when(long & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def stems(words: Column) -> Column:
    """array<string>: first fitting suffix rule, then -ate, doubled consonants and plurals.

    A transform a step: each step's result is made once, however often the next uses it.
    """
    for step in (_suffix, _ate, _doubled, _plural):
        words = F.transform(words, step)
    return words


def stem(word: Column) -> Column:
    return F.element_at(stems(F.array(word)), 1)


@lru_cache(200_000)
def stem_of(word: str) -> str:
    """What stems() makes of a word, for tasks that hold each distinct word once."""
    n = len(word)
    if word.endswith(_ENDINGS):
        word = next((word[: n - len(s)] + put for s, put in SUFFIXES if word.endswith(s) and n - len(s) + len(put) >= SHORTEST_STEM), word)
    if word.endswith("ate") and len(word) > 6:
        word = word[:-3]
    if len(word) > SHORTEST_STEM and word.endswith(_DOUBLES):
        word = word[:-1]
    if len(word) > SHORTEST_STEM and word.endswith("s"):
        return word[:-2] if word.endswith(_ES) else word if word.endswith("ss") else word[:-1]
    return word


def words(text: Column) -> Column:
    """array<string>: words of more than one character that aren't stop words."""
    return F.filter(F.split(normalise(text), " "), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def terms(text: Column) -> Column:
    """array<string>: stems of words()."""
    return stems(words(text))


def clean(text: Column) -> Column:
    """Line ends, plain punctuation, joined hyphens, no escapes, no page-number lines, no runs of blanks."""
    # single characters are replaced without a regular expression, which would go through every text once for each
    plain = (
        ("\r\n", "\n"), ("\r", "\n"), *((c, "'") for c in "\u2018\u2019\u201b"), *((c, '"') for c in "\u201c\u201d"), *((c, "-") for c in "\u2013\u2014"),
        ("\u2026", "..."), ("\u00a0", " "), ("\f", "\n"),
    )
    steps = (
        (r"([0-9A-Za-z_])-\n([0-9A-Za-z_])", "$1$2"), (r"\\([.\-+*_\[\]()#!`>~|$%])", "$1"),
        (r"(?im)^[^\S\n]*(?:page[^\S\n]+)?\d+[^\S\n]*(?:of[^\S\n]+\d+)?[^\S\n]*(?:\n|\z)", ""),
        (r"[ \t]+", " "), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"),
    )
    out = text
    for c, put in plain:
        out = F.replace(out, F.lit(c), F.lit(put))
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """array<string>: cut after . ! ? before a capital or digit; common abbreviations don't end one."""
    held = text
    for pattern, put in ((r"\bRs\.", "Rs\u0001"), (r"(?i)\b(e)\.(g)\.", "$1\u0001$2\u0001"), (r"(?i)\b(i)\.(e)\.", "$1\u0001$2\u0001"), (r"\bNo\.", "No\u0001"), (r"(?i)\b(Approx)\.", "$1\u0001")):
        held = F.regexp_replace(held, pattern, put)
    parts = F.split(held, r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: F.length(s) > 0)


def truncate_words(text: Column, most: int) -> Column:
    """At most `most` characters, cut at a space if that is in the last two fifths, and an ellipsis."""
    head = F.substring(text, 1, most)
    last = F.lit(most) - F.instr(F.reverse(head), " ") + F.lit(1)
    at_space = (F.instr(head, " ") > 0) & (last - 1 > most * 0.6)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.when(at_space, F.substring(head, F.lit(1), last - 1)).otherwise(head)), F.lit("\u2026")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


#: A character that no text has; it divides one while it is worked on, and goes if a text has it nevertheless.
DIVIDER = "\uffff"


def _without_scripts(html: Column) -> Column:
    """Scripts and styles gone, up to their ends. What isn't closed stays.

    A tag without an end is searched for it once: all that follows is set aside, in which no
    tag of that name is closed, and the other name is looked for there.
    """
    gone = lambda c, names: F.split(F.regexp_replace(F.concat(F.replace(c, F.lit(DIVIDER), F.lit("")), F.lit(DIVIDER)), rf"(?is)<({names})\b.*?</\1>|(<(?:{names})\b[^{DIVIDER}]*)({DIVIDER})", "$3$2"), DIVIDER)
    both = gone(html, "script|style")
    one = lambda c, name: F.array_join(gone(c, name), "")
    return F.concat(both[0], one(one(both[1], "script"), "style"))


def html_to_text(html: Column) -> Column:
    """Headings to #, list items to -, block ends to blank lines, cells to |; tags dropped, entities decoded.

    Time grows with the length of the page, whatever is left open in it: only what ends in a >
    can hold tags, so each of them is closed.
    """
    whole = F.regexp_replace(_without_scripts(html), r"(?s)<!--.*?-->|(<!--.*)\z", "$1")
    rest = F.substring_index(whole, ">", -1)
    tags = F.left(whole, F.length(whole) - F.length(rest))
    marks = (
        *((rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)),
        (r"(?i)<li[^>]*>", "\n- "), (r"(?i)</t[dh]>", " | "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|h[1-6]|tr|table|ul|ol|section|article)>", "\n\n"), (r"<[^>]+>", ""),
    )
    for pattern, put in marks:
        tags = F.regexp_replace(tags, pattern, put)
    out = F.concat(tags, rest)
    for pattern, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, put)
    return F.btrim(out, F.lit(" \t\n\x0b\f\r"))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def claims(text: Column) -> Column:
    """array<string>: the numeric claims of a text."""
    return F.regexp_extract_all(text, F.lit(CLAIM), F.lit(0))


def unsupported_claims(answer: Column, evidence: Column) -> Column:
    """Claims whose digits (two at least) the evidence doesn't hold once its separators are gone."""
    hay = F.translate(F.lower(evidence), "rs., \t\n", "")
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    return F.array_distinct(F.transform(F.filter(claims(answer), lambda c: (F.length(digits(c)) >= 2) & ~F.contains(hay, digits(c))), lambda c: F.trim(c)))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and all(map(unicodedata.combining, b[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_marks(text: Column) -> Column:
    """Letters without their marks, whether written as one character or as two."""
    return F.regexp_replace(F.translate(text, *_plain_letters()), "\\p{M}+", "")


def listed(text: Column) -> Column:
    """array<string>: the parts between commas, trimmed, without blank ones; null and blank give none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column, most: int = 80) -> Column:
    """Lower case, without marks, & spelled out, anything else than letters and digits a hyphen."""
    out = F.regexp_replace(F.replace(F.lower(without_marks(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, most), "-+$", "")


def mask(value: Column, head: int = 2, tail: int = 2) -> Column:
    """Keeps the ends and stars the rest; short values are starred whole."""
    n = F.length(value)
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, head), F.repeat(F.lit("*"), n - head - tail), F.right(value, F.lit(tail))))


def redact_address(address: Column) -> Column:
    """The last two parts of a comma-separated address."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    return F.when(F.size(parts) <= 2, F.array_join(parts, ", ")).otherwise(F.array_join(F.slice(parts, -2, 2), ", "))


def display(code: Column) -> Column:
    """in_progress -> In progress."""
    spaced = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, F.lit(2), F.length(spaced)))
