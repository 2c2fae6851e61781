"""Personal data by bootstrapped contextual extraction.

Base patterns (email, ip, card, phone) find the seeds. Seeds induce lexical patterns: the
word before, the word after, and both. A pattern-instance graph holds every token that looks
like an identifier together with its patterns; its edges are scored in rounds: a pattern by
the share of known instances among those it meets that are of another kind or look like
another, an instance by the patterns that point
to it, both counted over all documents. Tokens met by high-confidence patterns are new
spans of the kind of the pattern's seeds. Base spans stay as they are. All of it is
DataFrame work.

Texts are read twice, and not shuffled: once for the graph, and once for the spans, when the
trusted patterns are part of the plan, where a binary search finds them. Only if there are more
than TRUSTED of them are new spans joined to their rows instead.

What may be an identifier, and what a pattern is, are definitions of the model: a free token
has six characters or more, four of them digits; a context is the word next to it, at most three
other characters away, and of a word of more than 24 letters those next to the token. Mail
addresses, groups of digits and tokens may be of any length.

Where the words around identifiers tell nothing (in the test tables they are inserted at
random places, and every word meets all kinds), no pattern is trusted and none is found.

Nulls and edge cases: a null or empty text has no spans; a null doc_id is carried along;
rows with equal doc_id or text are searched each, and every row counts in the graph; rows
are told apart by 128 bits of doc_id and text, and equal ones have equal spans; of several
trusted patterns that meet a token the best one names it, ties go to the later kind; spans
of different kinds may overlap, new spans overlap no others; very long texts, also of one
run of digits or letters, take linear time; an empty table gives an empty result; other
columns stay, but for those that bear the name of a column that is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, count_below, discard, listed, load, small, stash

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive runs, and looks behind that rule out starts which
#: can't be leftmost, keep them linear; what they match is the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: What may be an identifier: emails without a top domain or written out, digits in groups, and
#: other tokens of at least six characters, four of them digits, behind white space, : or =.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?i:at)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]++)*+"
DIGITS = r"(?<![A-Za-z0-9@_%+])[+(]?[0-9]++(?:(?:\)[\x20./-]?\(?|[\x20./-]\(?|\()[0-9]++)*+(?![A-Za-z0-9@_%])"
TOKEN = r"(?<![^\x20\x09-\x0D:=])(?=[^\x20\x09-\x0D:=]{6})(?=(?:[^\x20\x09-\x0D:=0-9]*+[0-9]){4})[A-Za-z0-9+(][A-Za-z0-9@._()+/-]*[A-Za-z0-9]"
CANDIDATE = f"{MAIL}|{DIGITS}|{TOKEN}"
#: What a text must hold to have one.
MAYBE = r"[0-9][^\x20\x09-\x0D]*[0-9]|[0-9][\x20)(./-]{1,3}[0-9]|@|[(\[](?i:at)[)\]]"
DATE = r"^\(?(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})$"
#: Bit of a candidate that a trusted pattern of any kind makes a span, though it looks like none.
ANY = 1 << 4
MADE = ("_base", "_spans")
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: A pattern needs so many known instances, and so high a share of them.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.9, 2
#: Matches of a text that are put together at once.
BLOCK = 256
#: Trusted patterns up to this many go into the plan.
TRUSTED = 20_000


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match)> of the leftmost matches that don't overlap, in code points.

    Running lengths are added up in blocks, so that many matches don't copy a long array each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,match:string>>"

    def step(s: Column, m: Column) -> Column:
        begins = s["at"] + m["gap"]
        one = F.array(F.struct(begins.alias("start"), (begins + F.length(m["match"])).alias("end"), m["match"].alias("match")))
        full = F.size(s["block"]) == BLOCK
        return F.struct((begins + F.length(m["match"])).alias("at"), F.when(full, one).otherwise(F.concat(s["block"], one)).alias("block"), F.when(full, F.concat(s["done"], F.array(s["block"]))).otherwise(s["done"]).alias("done"))

    spans = F.aggregate(
        F.filter(F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("match")), lambda m: m["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("block"), F.array().cast(f"array<{kind}>").alias("done")),
        step,
        lambda s: F.concat(F.flatten(s["done"]), s["block"]),
    )
    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(spans)


def luhn(digits: Column) -> Column:
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(BYTE))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


#: What a text must hold for a kind to occur at all; spares most texts the search.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}


def base_spans(text: Column) -> Column:
    """array<struct(start, kind, end)>, sorted; kind is the index in KINDS."""
    none = F.array().cast(SPAN)
    each = []
    for k, kind in enumerate(KINDS):
        # the functions take their place in the list before the loop goes on
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"]))  # noqa: B023
        each.append(F.when(NEEDS[kind](text), F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))).otherwise(none))  # noqa: B023
    return F.array_sort(F.concat(*each))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _word_before(text: Column, start: Column) -> Column:
    """The last word before the place, lower-cased, without punctuation; empty if there is none near."""
    near = F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40)))
    return F.lower(F.regexp_extract(near, r"([\p{L}]{1,24})[^\p{L}0-9]{0,3}$", 1))


def _word_after(text: Column, end: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(text, end + 1, F.lit(40)), r"^[^\p{L}0-9]{0,3}([\p{L}]{1,24})", 1))


def _may(token: Column) -> Column:
    """Bits of the kinds that a token without a kind looks like, and ANY; null if it is no candidate.

    A date speaks against a pattern and never is a span.
    """
    n = F.length(F.regexp_replace(token, "[^0-9]", ""))
    email, ip, card, phone = (F.lit(1 << k) for k in range(len(KINDS)))
    whole = F.when((F.length(token) >= 6) & ~token.contains(" "), F.lit(ANY)).otherwise(F.lit(0))
    digits = F.when(n.between(12, 15), card.bitwiseOR(phone)).when(n.between(7, 11), phone).when(n.between(16, 19), card).otherwise(F.lit(0))
    number = token.rlike(r"^[+(]?[0-9][0-9\x20()./-]*$")
    return F.when(token.rlike(f"^(?:{MAIL})$"), email).when(n < 4, F.lit(None).cast("int")).when(token.rlike(DATE), F.lit(0)).when(number, digits.bitwiseOR(whole)).otherwise(whole)


def _fits() -> Column:
    """A candidate may get the kind k: it looks like it, or is a token of no look at all."""
    return F.expr(f"(may & (shiftleft(1, k) | {ANY})) <> 0")


def _found(text: Column, base: Column) -> Column:
    """array<struct(start, end, token, kind, may, patterns)>: tokens like identifiers and their patterns.

    kind is that of the base span, else null, and then may says which it looks like. A
    pattern is the words on both sides, or the word before or after alone where that is near.
    """

    def one(start: Column, end: Column, token: Column, kind: Column) -> Column:
        # contexts are cut out here, so that exploded rows don't carry the text
        return F.struct(start.alias("start"), end.alias("end"), F.lower(token).alias("token"), kind.alias("kind"), _word_before(text, start).alias("b"), _word_after(text, end).alias("a"))

    def told(m: Column) -> Column:
        b, a = m["b"], m["a"]
        patterns = F.filter(F.array(F.when(b != "", F.concat(F.lit("b:"), b)), F.when(a != "", F.concat(F.lit("a:"), a)), F.when((b != "") & (a != ""), F.concat(F.lit("ba:"), b, F.lit(" "), a))), lambda p: p.isNotNull())
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["token"].alias("token"), m["kind"].alias("kind"), F.when(m["kind"].isNull(), _may(m["token"])).alias("may"), patterns.alias("patterns"))

    seeds = F.transform(base, lambda s: one(s["start"], s["end"], F.substring(text, s["start"] + 1, s["end"] - s["start"]), s["kind"]))
    tokens = F.when(text.rlike(MAYBE), matches(text, CANDIDATE)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    free = F.filter(tokens, lambda m: ~F.exists(base, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    other = F.transform(free, lambda m: one(m["start"], m["end"], m["match"], F.lit(None).cast("int")))
    return F.filter(F.transform(F.concat(seeds, other), told), lambda m: m["kind"].isNotNull() | m["may"].isNotNull())


def candidates(rows: DataFrame) -> DataFrame:
    """(_row, start, end, token, kind, may, pattern): what _found() tells of (_row, text, _base), a row a pattern."""
    each = rows.select("_row", F.explode(_found(F.col("text"), F.col("_base"))).alias("m"))
    return each.select("_row", "m.start", "m.end", "m.token", "m.kind", "m.may", F.explode("m.patterns").alias("pattern"))


def learn(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the patterns to trust, from candidates().

    The graph has one edge a (pattern, token). Known tokens score 1; in each round patterns
    get the mean score of their tokens, leaving out those without a kind that look like the
    pattern's (they count neither for nor against it), and are trusted from `confidence` on, with `support`
    tokens at least; tokens then get the best score of a trusted pattern.
    """
    edges = stash(found.groupBy("pattern", "token").agg(F.max("kind").alias("kind"), F.max("may").alias("may"), F.count("*").alias("n")), "pii_edges")
    state = edges.select("pattern", "token", "kind", "may", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    for i in range(rounds):
        each = []
        for k in range(len(KINDS)):
            open_ = F.col("kind").isNull() & (F.col("may").bitwiseAND(F.lit(1 << k)) != 0)
            each.append(F.struct(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias("s"), F.lit(k).alias("k"), F.count_if(~F.coalesce(open_, F.lit(False))).alias("n")))
        # a pattern belongs to the kind that most of its tokens' score has
        per = state.groupBy("pattern").agg(F.greatest(*each).alias("best"))
        trusted = per.where((F.col("best.s") >= support) & (F.col("best.s") >= confidence * F.col("best.n")))
        trusted = stash(trusted.select("pattern", F.col("best.k").alias("k"), (F.col("best.s") / F.col("best.n")).alias("p")), "pii_trusted")
        if i == rounds - 1:
            break
        lifted = state.where("kind is null").join(small(trusted), "pattern").where(_fits()).groupBy("token").agg(F.max(F.struct("p", "k")).alias("up"))
        got = state.join(lifted, "token", "left")
        state = stash(got.select("pattern", "token", F.coalesce("kind", F.col("up.k")).alias("kind"), "may", F.when(F.col("kind").isNull(), F.greatest("score", F.coalesce(F.col("up.p"), F.lit(0.0)))).otherwise(F.col("score")).alias("score")), "pii_state")
    return trusted.select("pattern", F.col("k").alias("kind"), F.col("p").alias("score"))


def _discovered(text: Column, base: Column, known: list) -> Column:
    """New spans of a text: candidates with a trusted pattern that fits; known: (pattern, kind, score), in order of pattern.

    Of several patterns the one with the best score names the span, ties go to the later kind.
    """
    if not known:
        return F.array().cast(SPAN)
    names, kinds, scores = (listed([r[i] for r in known], t) for i, t in enumerate(("string", "int", "double")))

    def best(m: Column) -> Column:
        def of(pattern: Column) -> Column:
            at = count_below(len(known), lambda i: F.element_at(names, i + 1) < pattern) + 1
            hit = (at <= len(known)) & (F.element_at(names, F.least(at, F.lit(len(known)))) == pattern)
            kind = F.element_at(kinds, F.least(at, F.lit(len(known))))
            fits = m["may"].bitwiseAND(F.element_at(F.array(*[F.lit(1 << k | ANY) for k in range(len(KINDS))]), kind + 1))
            return F.when(hit & (fits != 0), F.struct(F.element_at(scores, F.least(at, F.lit(len(known)))).alias("score"), kind.alias("kind")))

        named = F.array_max(F.filter(F.transform(m["patterns"], of), lambda x: x.isNotNull()))
        return F.struct(m["start"].alias("start"), named["kind"].alias("kind"), m["end"].alias("end"))

    free = F.filter(_found(text, base), lambda m: m["kind"].isNull())
    return F.filter(F.transform(free, best), lambda s: s["kind"].isNotNull()).cast(SPAN)


def extract(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """docs, a null text empty, and _base, _spans: array<struct(start, kind, end)>, the base spans and all spans."""
    text = F.coalesce("text", F.lit(""))
    filled, fields = apart(docs.withColumn("text", text), MADE, "doc_id", "text")
    marked = filled.select("_row", "text", base_spans(F.col("text")).alias("_base"), F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary")).alias("_id"))
    found = stash(candidates(marked.select(F.col("_id").alias("_row"), "text", "_base")), "pii_found")
    trusted = learn(found, support, confidence, rounds)
    known = trusted.limit(TRUSTED + 1).collect()
    if len(known) <= TRUSTED:
        # by bytes, as Spark orders strings
        known = sorted(((r.pattern, r.kind, r.score) for r in known), key=lambda r: r[0].encode())
        discard(found)
        got = marked.withColumn("_new", _discovered(F.col("text"), F.col("_base"), known))
    else:
        # equal rows have the same spans, so the row's digest stands for them
        more = found.where("kind is null").drop("kind").join(small(trusted).withColumn("k", F.col("kind")), "pattern").where(_fits()).groupBy("_row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
        new = more.groupBy(F.col("_row").alias("_of")).agg(F.collect_list(F.struct("start", F.col("best.kind").alias("kind"), "end")).alias("_new"))
        got = marked.join(small(stash(new, "pii_new")), F.col("_id") == F.col("_of"), "left")
    spans = F.array_sort(F.concat("_base", F.coalesce(F.col("_new").cast(SPAN), F.array().cast(SPAN))))
    return got.select(*fields, "_base", spans.alias("_spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <kind>; of overlapping spans the first names it."""
    name = F.array(*map(F.lit, KINDS))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, m: F.when(m["start"] < s["at"], F.struct(F.greatest(s["at"], m["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(m["end"].alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.concat(F.lit("<"), F.element_at(name, m["kind"] + 1), F.lit(">")))).alias("out"))
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(load(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of extract(): the base spans."""
    return query(spark, sf_dir).drop("spans")


#: A kind's matches and what lies between them; starts are running lengths of both.
_MATCHES = """
{kind}0 AS (SELECT id, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS g FROM d WHERE regexp_matches(text, '{rx}')),
{kind}1 AS (SELECT id, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS begins FROM {kind}0),
{kind} AS (SELECT id, {k} AS k, '{kind}' AS kind, begins, begins + length(m) AS upto, regexp_replace(m, '[^0-9]', '', 'g') AS digits, m FROM {kind}1),"""
_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INTEGER) WHEN CAST(digits[-i] AS INTEGER) > 4 THEN CAST(digits[-i] AS INTEGER) * 2 - 9 ELSE CAST(digits[-i] AS INTEGER) * 2 END)) % 10 = 0"
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
BASE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents),
{"".join(_MATCHES.format(kind=kind, k=k, rx=_PLAIN[kind]) for k, kind in enumerate(KINDS))}
a AS (SELECT * FROM email UNION ALL SELECT * FROM ip WHERE len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0
  UNION ALL SELECT * FROM card WHERE length(digits) BETWEEN 12 AND 19 AND {_LUHN}
  UNION ALL SELECT * FROM phone WHERE length(digits) BETWEEN 9 AND 15),
s AS (SELECT id, {", ".join(f"count_if(kind = '{kind}') AS n_{kind}" for kind in KINDS)}, string_agg(kind || ':' || begins || ':' || upto, ',' ORDER BY begins, k) AS spans FROM a GROUP BY id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (id)
"""
