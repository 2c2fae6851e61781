"""Texts, classification, documents, vectors, product search, merges and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import values as V
from ..operators import aggregates as A
from ..operators import knowledge as K
from ..operators import merges as M
from ..operators import vectors
from ..operators.index import Index
from .registry import AS_OF, ORACLES, QUERIES, as_of, moment, query, table


def _any(column: str, terms: tuple[str, ...]) -> str:
    """SQL: one of the terms is in the column."""
    return "(" + " OR ".join(f"contains({column}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


def _said(spark: SparkSession, d: str) -> DataFrame:
    """User turns, each behind a phrase of a fixed list, so that rules have something to find."""
    k = (F.col("conv_id") * 7 + F.col("turn") * 3) % len(PHRASES)
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.concat(F.element_at(F.array(*map(F.lit, PHRASES)), (k + 1).cast("int")), F.lit(" "), F.col("text")).alias("said"))


PHRASES = (
    "Where is my order UC-10452?", "I want to buy a phone, my budget is 2 lakh.", "My parcel arrived broken!", "This is unacceptable, third time!",
    "What is the return policy?", "Can I talk to a human", "How much is it?", "Everything is down", "I was charged twice", "I forgot my password",
    "Is it in stock in Lahore", "", "just browsing around Rs. 45,000", "reset it ASAP, locked out", "order uc 10457 has not arrived",
)
_SAID = (
    "(SELECT conv_id, turn, [" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + f"][CAST((conv_id * 7 + turn * 3) % {len(PHRASES)} AS INTEGER) + 1] || ' ' || text AS said FROM conversations WHERE role = 'user')"
)
_LOW = f"(SELECT conv_id, turn, said, lower(trim(said)) AS t, trim(said) AS raw FROM {_SAID})"


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_any('t', words)} THEN '{name}'" for name, words in R.TICKET_BANDS) + f" ELSE 'Low' END AS priority FROM {_LOW}")
def ticket_priority_bands(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", R.ticket_priority(F.col("said")).alias("priority"))


_ROUTE = "CASE " + " ".join(f"WHEN {_any('t', words)} THEN '{name}'" for name, words in R.ROUTER) + " ELSE 'General Enquiry' END"


@query(
    "SELECT conv_id, turn, CASE WHEN r = 'Critical' THEN 'Technical Issue' ELSE r END AS intent, CASE r "
    + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in R.ROUTES.items()) + " END AS severity, CASE r " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in R.ROUTES.items())
    + " END AS action, r IN (" + ", ".join(f"'{k}'" for k, v in R.ROUTES.items() if v[2]) + f") AS needs_ticket FROM (SELECT *, {_ROUTE} AS r FROM {_LOW})"
)
def intent_router(spark: SparkSession, d: str) -> DataFrame:
    got = _said(spark, d).select("conv_id", "turn", R.route(F.col("said")).alias("r"))
    return got.select("conv_id", "turn", "r.intent", "r.severity", "r.action", "r.needs_ticket")


_FLAGS = (
    f"(SELECT *, {_any('t', R.DAMAGE)} AS damaged, {_any('t', R.REFUND)} AS refund, {_any('t', R.HUMAN)} AS human, "
    f"{_any('t', R.ANGRY)} OR (length(raw) > 15 AND raw = upper(raw) AND regexp_matches(raw, '[A-Z]{{4,}}')) AS angry, regexp_matches(raw, '(?i)\\buc[- ]?[0-9]{{5}}\\b') AS num FROM {_LOW})"
)


@query(
    "SELECT conv_id, turn, CASE WHEN human THEN 'handoff' WHEN damaged OR (angry AND (num OR refund)) THEN 'complaint' "
    f"WHEN refund AND NOT {_any('t', ('refund policy', 'refund process', 'how long'))} THEN 'complaint' WHEN num OR {_any('t', R.ORDER)} THEN 'order_status' "
    f"WHEN {_any('t', R.BUY)} AND (regexp_matches(t, '\\b(budget|afford|spend|spending|price range|under|below|around|about|up\\s?to|maximum|max)\\b[^0-9]{{0,24}}[0-9]') OR regexp_matches(t, '\\b(rs\\.?|pkr)\\s?[0-9]') OR regexp_matches(t, '\\b[0-9.]+\\s*(k|lakhs|lakh|lac|crore)\\b')) THEN 'lead_capture' "
    f"WHEN {_any('t', R.POLICY)} THEN 'policy_question' WHEN {_any('t', R.PRICE)} THEN 'price_inquiry' WHEN {_any('t', R.AVAILABLE)} THEN 'availability_inquiry' WHEN angry THEN 'complaint' "
    f"WHEN {_any('t', R.GREETING)} AND length(raw) < 40 THEN 'greeting' ELSE 'unknown' END AS intent FROM {_FLAGS}"
)
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", R.intent(F.col("said"))["intent"].alias("intent"))


@query(
    "SELECT conv_id, turn, CASE trig WHEN 'customer_requested_human' THEN 'other' WHEN 'complex_refund' THEN 'refund_request' ELSE trig END AS issue, CASE WHEN trig IN ('damaged_product', 'angry_customer') THEN 'urgent' ELSE 'high' END AS priority, "
    "CASE WHEN trig IN ('damaged_product', 'angry_customer') THEN 1 ELSE 4 END AS hours, strftime(TIMESTAMP '" + AS_OF + "' + to_hours(CASE WHEN trig IN ('damaged_product', 'angry_customer') THEN 1 ELSE 4 END), '%Y-%m-%d %H:%M:%S') AS due FROM (SELECT *, CASE WHEN human THEN 'customer_requested_human' WHEN damaged THEN 'damaged_product' WHEN angry THEN 'angry_customer' WHEN refund THEN 'complex_refund' END AS trig "
    f"FROM {_FLAGS}) WHERE trig IS NOT NULL"
)
def escalation_policy(spark: SparkSession, d: str) -> DataFrame:
    """Messages that go to a person, with issue, priority, hours to answer, and the moment when they are over."""
    got = _said(spark, d).select("conv_id", "turn", R.escalation(F.col("said")).alias("e")).where("e is not null")
    due = moment(as_of() + F.make_dt_interval(hours=F.col("e.hours")))
    return got.select("conv_id", "turn", "e.issue", "e.priority", "e.hours", due.alias("due"))


@query(f"SELECT conv_id, turn, 'UC-' || regexp_extract(said, '(?i)\\buc[- ]?([0-9]{{5}})\\b', 1) AS order_number FROM {_SAID} WHERE regexp_matches(said, '(?i)\\buc[- ]?[0-9]{{5}}\\b')")
def order_number_extract(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", R.order_number(F.col("said")).alias("order_number")).where("order_number is not null")


def _amount(x: str) -> str:
    """SQL: the whole amount that a text states."""
    t = f"trim(regexp_replace(lower({x}), 'rs\\.?|pkr|rupees?', '', 'g'))"
    scaled = " ".join(f"WHEN regexp_matches({t}, '[0-9.]+\\s*{unit}') THEN CAST(floor(TRY_CAST(regexp_extract({t}, '([0-9.]+)\\s*{unit}', 1) AS DOUBLE) * {n} + 0.5) AS BIGINT)" for unit, n in (("(?:lakhs|lakh|lac)", 100_000), ("crore", 10_000_000), ("k\\b", 1_000)))
    return f"CASE {scaled} ELSE CAST(floor(TRY_CAST(nullif(regexp_extract(regexp_replace({t}, '[,\\s]', '', 'g'), '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) + 0.5) AS BIGINT) END"


_STATED = (
    r"(?i)\b(?:budget|afford|spend|spending|price range|under|below|around|about|up\s?to|maximum|max)\b[^0-9]{0,24}((?:(?:rs\.?|pkr)?\s?[0-9][0-9,.\s]*\s*(?:k\b|lakhs|lakh|lac|crore)?))",
    r"(?i)\b(?:rs\.?|pkr)\s?([0-9][0-9,.\s]*\s*(?:k\b|lakh|lac|crore)?)", r"(?i)\b([0-9.]+\s*(?:k|lakhs|lakh|lac|crore)\b)",
)
_BUDGET = "coalesce(" + ", ".join(f"CASE WHEN ({_amount(f'a{i}')}) > 0 THEN {_amount(f'a{i}')} END" for i in range(3)) + ")"


@query(f"SELECT conv_id, turn, {_BUDGET} AS budget FROM (SELECT conv_id, turn, " + ", ".join(f"nullif(regexp_extract(said, '{p}', 1), '') AS a{i}" for i, p in enumerate(_STATED)) + f" FROM {_SAID})")
def budget_extract(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", V.budget_in(F.col("said")).alias("budget"))


@query(
    "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\b{c}\\b') THEN '{c.capitalize()}'" for c in R.CITIES)
    + " END AS location, CASE " + " ".join(f"WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{stage}'" for stage, p in R.BUYING_STAGES) + f" WHEN {_any('t', R.BUY)} THEN 'considering' END AS stage FROM {_LOW}"
)
def entities_extract(spark: SparkSession, d: str) -> DataFrame:
    said = F.col("said")
    return _said(spark, d).select("conv_id", "turn", R.location(said).alias("location"), R.buying_stage(said).alias("stage"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, '')) AS n_chars, CAST(ceil(length(coalesce(text, '')) / 4.0) AS INTEGER) AS token_estimate, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'failed' ELSE 'ok' END AS status FROM documents")
def document_facts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("content_hash"), F.length(t).cast("long").alias("n_chars"), T.token_estimate(t).alias("token_estimate"), F.when(F.length(F.trim(t)) < 20, "failed").otherwise("ok").alias("status"))


def _chain(x: str, steps: tuple[tuple[str, str], ...]) -> str:
    """SQL: replacements one after the other."""
    for pattern, put in steps:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {put if put.startswith('chr') or put.startswith(chr(39)) else chr(39) + put + chr(39)}, 'g')"
    return x


_CLEAN = _chain("coalesce(text, '')", (
    (r"\r\n?", "chr(10)"), ("[\u2018\u2019\u201b]", "chr(39)"), ("[\u201c\u201d]", '"'), ("[\u2013\u2014]", "-"), ("\u2026", "..."), ("\u00a0", " "), (r"\f", "chr(10)"),
    (r"([0-9A-Za-z_])-\n([0-9A-Za-z_])", r"\1\2"), (r"\\([.\-+*_\[\]()#!`>~|$%])", r"\1"),
    (r"(?im)^[^\S\n]*(?:page[^\S\n]+)?\d+[^\S\n]*(?:of[^\S\n]+\d+)?[^\S\n]*(?:\n|\z)", ""), (r"[ \t]+", " "), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", ""),
))
_HTML = _chain("coalesce(html, '')", (
    (r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"(?s)<!--.*?-->", ""), *((rf"(?i)<h{n}[^>]*>", f"chr(10) || '{'#' * n} '") for n in range(1, 7)),
    (r"(?i)<li[^>]*>", "chr(10) || '- '"), (r"(?i)</t[dh]>", " | "), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|h[1-6]|tr|table|ul|ol|section|article)>", "chr(10) || chr(10)"),
    (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "chr(39)"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", ""),
))


def _stem(w: str) -> tuple[str, ...]:
    """SQL: the steps of a stem, each from the column w of the one before."""
    rules = " ".join(f"WHEN ends_with(w, '{a}') AND length(w) - {len(a) - len(b)} >= {T.SHORTEST_STEM} THEN left(w, length(w) - {len(a)}) || '{b}'" for a, b in T.SUFFIXES)
    return (
        f"CASE {rules} ELSE w END", "CASE WHEN ends_with(w, 'ate') AND length(w) > 6 THEN left(w, length(w) - 3) ELSE w END",
        f"CASE WHEN regexp_matches(w, '(bb|dd|ff|gg|ll|mm|nn|pp|rr|tt)$') AND length(w) > {T.SHORTEST_STEM} THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN length(w) > {T.SHORTEST_STEM} AND regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, length(w) - 2) WHEN length(w) > {T.SHORTEST_STEM} AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
    )


_WORDS = "(SELECT w FROM (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_TERMS = _WORDS
for _step in _stem("w"):
    _TERMS = f"(SELECT {_step} AS w FROM {_TERMS})"


@query(f"SELECT doc_id, sha256({_CLEAN}) AS clean_sha256 FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.clean(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("clean_sha256"))


_HELD = _chain("coalesce(text, '')", ((r"\bRs\.", "'Rs' || chr(1)"), (r"(?i)\b(e)\.(g)\.", r"'\1' || chr(1) || '\2' || chr(1)"), (r"(?i)\b(i)\.(e)\.", r"'\1' || chr(1) || '\2' || chr(1)"), (r"\bNo\.", "'No' || chr(1)"), (r"(?i)\b(Approx)\.", r"'\1' || chr(1)")))
# what follows a gap isn't consumed there, so gaps are marked twice: a mark may itself begin the next
_GAPS = _chain(_HELD, ((r"([.!?])\s+([A-Z0-9])", r"'\1' || chr(2) || '\2'"), (r"([.!?])\s+([A-Z0-9])", r"'\1' || chr(2) || '\2'")))


@query(f"SELECT doc_id, count(*) FILTER (length(trim(translate(s, chr(1), '.'), ' ')) > 0) AS n_sentences FROM (SELECT doc_id, unnest(string_split({_GAPS}, chr(2))) AS s FROM documents) GROUP BY 1")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("n_sentences"))


@query(f"SELECT w AS term, count(*) AS n FROM {_TERMS} GROUP BY 1")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed terms of each document, counted; Spark counts, so no text leaves its row."""
    each = table(spark, d, "documents").select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word"))
    # words are counted first, so that each is stemmed once
    return each.groupBy("word").agg(F.count("*").alias("n")).groupBy(T.stem(F.col("word")).alias("term")).agg(F.sum("n").alias("n"))


@query(
    """WITH n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
    l AS (SELECT DISTINCT source, doc_id, trim(line, ' ') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
    c AS (SELECT source, line, count(*) AS n FROM l WHERE length(line) BETWEEN 8 AND 120 GROUP BY 1, 2)
    SELECT c.source, line, c.n FROM c JOIN n USING (source) WHERE c.n >= n.pages * 0.05"""
)
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines on a share of a source's documents; the share fits the table."""
    return K.repeated_lines(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], "doc_id", 0.05)


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.coalesce("html", F.lit(""))).alias("text"))


_CLAIM = r"(?i)(?:rs\.?\s?)?\b\d{1,3}(?:,\d{3})+\b|\b\d+\s*(?:days|day|weeks|week|months|month|years|year|%|percent)\b|\brs\.?\s?\d+\b"


@query(
    f"""WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(d.text, '') || ' Returned within 14 days it costs Rs. 1,200.', '{_CLAIM}') AS said,
      translate(lower(concat_ws(' ', i.text, CASE WHEN doc_id % 2 = 0 THEN 'The fee is Rs 1,200' END)), 'rs., ' || chr(9) || chr(10), '') AS hay FROM documents d LEFT JOIN benchmark i ON i.item_id = doc_id % 50),
    c AS (SELECT DISTINCT doc_id, trim(c) AS claim FROM (SELECT doc_id, hay, unnest(said) AS c FROM b) WHERE length(regexp_replace(c, '[^0-9]', '', 'g')) >= 2 AND NOT contains(hay, regexp_replace(c, '[^0-9]', '', 'g')))
    SELECT doc_id, count(*) AS n, string_agg(claim, '|' ORDER BY claim) AS claims FROM c GROUP BY 1"""
)
def unsupported_claims(spark: SparkSession, d: str) -> DataFrame:
    """Numeric claims of documents that the next benchmark item doesn't hold."""
    # fifty items are asked for, so they go to the documents
    items = table(spark, d, "benchmark").where("item_id between 0 and 49").select("item_id", F.col("text").alias("evidence"))
    items = F.broadcast(items) if items.limit(1_001).count() <= 1_000 else items
    both = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 50).join(items, "item_id", "left")
    answer = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit("Returned within 14 days it costs Rs. 1,200."))
    known = F.concat_ws(" ", "evidence", F.when(F.col("doc_id") % 2 == 0, "The fee is Rs 1,200"))
    got = both.select("doc_id", F.array_sort(T.unsupported_claims(answer, known)).alias("c")).where(F.size("c") > 0)
    return got.select("doc_id", F.size("c").cast("long").alias("n"), F.array_join("c", "|").alias("claims"))


@query(
    """WITH a AS (SELECT *, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS was FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
    c AS (SELECT * FROM a WHERE was IS DISTINCT FROM sha256(text))
    SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS version, CASE WHEN lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) IS NULL THEN 'active' ELSE 'superseded' END AS status FROM c"""
)
def doc_hash_versions(spark: SparkSession, d: str) -> DataFrame:
    """A source's documents as arrivals of one file: only changed content makes a version."""
    arrivals = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return K.versions(arrivals, ["source"], "doc_id").select("doc_id", "source", "version", "status")


@query("SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN 'created' WHEN p.h <> sha256(d.text) THEN 'updated' ELSE 'skipped' END AS action FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('old') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0) p USING (doc_id)")
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """A run against a store that knows four fifths of the documents, a third of them in an older form."""
    now = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    store = now.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("old").cast("binary"), 256)).otherwise(F.col("hash")).alias("known"))
    both = now.join(store, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("known").isNull(), "created").when(F.col("known") != F.col("hash"), "updated").otherwise("skipped").alias("action"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_documents(table(spark, d, "documents"))


@query()
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return K.hashed_embedding(table(spark, d, "documents").select("doc_id", "text"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set of the searches, every 20th vector; it grows with the table."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_COS = "SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0"


@query(f"SELECT query_id, vec_id, round(similarity, 4) AS similarity FROM ({_COS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    got = K.top_k(table(spark, d, "embeddings"), _asked(spark, d), 5, order=[F.col("vec_id")])
    return got.select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"SELECT query_id, vec_id, label FROM ({_COS}) WHERE label IN (1, 2, 3) AND similarity >= 0.0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and a least similarity are applied before ranks are given."""
    got = K.top_k(table(spark, d, "embeddings"), _asked(spark, d), 5, 0.0, F.col("label").isin(1, 2, 3), [F.col("vec_id")])
    return got.select("query_id", "vec_id", "label")


@query(f"SELECT query_id, round(max(similarity) FILTER (rn = 1), 4) AS best, round(avg(similarity) FILTER (rn IN (2, 3)), 4) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM ({_COS})) GROUP BY 1")
def mean_agreement(spark: SparkSession, d: str) -> DataFrame:
    ranked = K.top_k(table(spark, d, "embeddings"), _asked(spark, d), 5, order=[F.col("vec_id")])
    return K.confidence(ranked).select("query_id", F.round("best", 4).alias("best"), F.round("agreement", 4).alias("agreement"))


@query(
    f"""WITH s AS ({_COS}), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s WHERE label IN (1, 2, 3)),
    cw AS (SELECT query_id, round(greatest(0, least(1, 0.55 * max(similarity) FILTER (rn = 1) + 0.15 * coalesce(avg(similarity) FILTER (rn IN (2, 3)), 0))), 3) AS c FROM w WHERE rn <= 5 GROUP BY 1),
    cn AS (SELECT query_id, round(greatest(0, least(1, 0.55 * max(similarity) FILTER (rn = 1) + 0.15 * coalesce(avg(similarity) FILTER (rn IN (2, 3)), 0))), 3) AS c FROM n WHERE rn <= 5 GROUP BY 1)
    SELECT query_id, greatest(coalesce(cn.c, 0), cw.c) AS confidence, cw.c > coalesce(cn.c, 0) AS widened, CASE WHEN greatest(coalesce(cn.c, 0), cw.c) >= 0.22 THEN 'grounded' ELSE 'refused' END AS status FROM cw LEFT JOIN cn USING (query_id)"""
)
def grounding_status(spark: SparkSession, d: str) -> DataFrame:
    """Search within the hinted kinds, then once among all; the better confidence counts."""
    rows, asked = vectors.store(table(spark, d, "embeddings"), "label"), _asked(spark, d)
    narrow = K.confidence(K.top_k(rows, asked, 5, where=F.col("label").isin(1, 2, 3), order=[F.col("vec_id")])).select("query_id", F.col("confidence").alias("n"))
    wide = K.confidence(K.top_k(rows, asked, 5, order=[F.col("vec_id")])).select("query_id", F.col("confidence").alias("w"))
    both = wide.join(narrow, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    best = F.greatest("n", "w")
    return both.select("query_id", best.alias("confidence"), (F.col("w") > F.col("n")).alias("widened"), F.when(best >= 0.22, "grounded").otherwise("refused").alias("status"))


@query()
def vector_topk_approx(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest, looked for in the cells nearest to each query; part of what vector_topk finds."""
    rows = table(spark, d, "embeddings")
    cells = vectors.train(rows)
    got = K.top_k(vectors.store(rows, cells=cells), _asked(spark, d), 5, order=[F.col("vec_id")], cells=cells)
    return got.select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


# the searches' other names
for _name in ("vector_topk", "vector_topk_filtered", "mean_agreement", "grounding_status"):
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]


@query()
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of the chunks nearest to every 20th benchmark item that share most terms with the item."""
    items = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text"), T.terms(F.col("text")).alias("asked"))
    asked = K.hashed_embedding(items.select("query_id", "text")).withColumnRenamed("embedding", "query")
    # chunks keep their texts through the search, so that they are made once
    pieces = K.chunk_documents(table(spark, d, "documents"), dims=K.DIMS).select("doc_id", "chunk_index", "chunk_text", "embedding")
    near = K.top_k(pieces, asked, 5, 0.08, order=[F.col("doc_id"), F.col("chunk_index")]).join(items.select("query_id", "asked"), "query_id")
    return K.extractive_answer(near, F.col("asked")).select("query_id", "rank", "sentence", "score")


SEARCHES = ("small ring", "red", "widget blue", "Brand#12", "bolt", "green gear", "nothing here")
_SEARCHES = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEARCHES)) + ") AS s(query_id, q)"


@query(
    f"""WITH c AS (SELECT query_id, p_partkey, 1 AS stage, 1.0::DOUBLE AS score FROM {_SEARCHES} JOIN part ON lower(p_brand) = lower(q)
    UNION ALL SELECT query_id, p_partkey, 2, CASE WHEN p_name = lower(q) THEN 1.0::DOUBLE WHEN list_contains(string_split(p_name, ' '), lower(q)) THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END FROM {_SEARCHES} JOIN part ON p_name = lower(q) OR list_contains(string_split(p_name, ' '), lower(q)) OR starts_with(p_name, lower(q)) OR starts_with(lower(q), p_name)
    UNION ALL SELECT query_id, p_partkey, 3, least({R.RANK_CAP}::DOUBLE, {R.RANK_SCALE} * sum(0.1::DOUBLE * k / {R.RANK_LIMIT}::DOUBLE) / any_value(terms)) FROM (
      SELECT query_id, p_partkey, term, any_value(terms) AS terms, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0::DOUBLE / (i * i))) AS k
      FROM (SELECT query_id, unnest(list_distinct(string_split(lower(q), ' '))) AS term, len(list_distinct(string_split(lower(q), ' '))) AS terms FROM {_SEARCHES}) JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) ON word = term GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT query_id, p_partkey, stage, round(score, 6) AS score FROM c QUALIFY stage = min(stage) OVER (PARTITION BY query_id)"""
)
def product_search_staged(spark: SparkSession, d: str) -> DataFrame:
    """Code, then name or alias, then words; a later stage counts only if the earlier ones find nothing."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.split("p_name", " ").alias("words"))
    asked = F.broadcast(spark.createDataFrame([(i, s.lower()) for i, s in enumerate(SEARCHES)], "query_id int, q string"))
    by_code = parts.join(asked, F.lower("p_brand") == F.col("q")).select("query_id", "p_partkey", F.lit(1).alias("stage"), F.lit(1.0).alias("score"))
    named = parts.join(asked, (F.col("p_name") == F.col("q")) | F.array_contains("words", F.col("q")) | F.col("p_name").startswith(F.col("q")) | F.col("q").startswith(F.col("p_name")))
    by_name = named.select("query_id", "p_partkey", F.lit(2).alias("stage"), F.when(F.col("p_name") == F.col("q"), 1.0).when(F.array_contains("words", F.col("q")), 0.95).otherwise(0.8).alias("score"))
    # words meet words in a kept index: searches read the postings of their terms
    index = Index(spark, parts.schema["p_partkey"].dataType)
    index.add(parts.select(F.col("p_partkey").alias("id"), F.col("words").alias("terms")))
    ranked = index.search(asked.select("query_id", F.split("q", " ").alias("terms"))).withColumnRenamed("id", "p_partkey")
    score = F.least(F.lit(R.RANK_CAP), R.RANK_SCALE * R.text_rank(F.col("counts"), F.col("n_terms")))
    by_word = ranked.select("query_id", "p_partkey", F.lit(3).alias("stage"), score.alias("score"))
    return M.staged(by_code, by_name, by_word).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda a: starts_with(a, 'wid') OR starts_with('wid', a))) > 0")
def alias_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.exists(F.split("p_name", " "), lambda a: a.startswith("wid") | F.startswith(F.lit("wid"), a))).select("p_partkey")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click'),
    f AS (SELECT user_id, event_id, t, rn, t AS kept, TRUE AS keep FROM e WHERE rn = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN e.t - f.kept >= 86400000000 THEN e.t ELSE f.kept END, e.t - f.kept >= 86400000000 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM f GROUP BY 1"""
)
def dedupe_leads_24h(spark: SparkSession, d: str) -> DataFrame:
    """Enquiries within a day of the last kept one are duplicates of it."""
    clicks = table(spark, d, "events").where("event_type = 'click'")
    got = A.window_limits(clicks, "user_id", F.col("ts").cast("timestamp"), 86_400_000_000, 1)
    return got.select("user_id", F.col("accepted").alias("kept"), F.col("rejected").alias("dropped"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, t, rn, t AS at, 1 AS n FROM e WHERE rn = 1 UNION ALL
      SELECT e.user_id, e.t, e.rn, CASE WHEN e.t - f.at >= 43200000000 THEN e.t ELSE f.at END, CASE WHEN e.t - f.at >= 43200000000 THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, count(*) FILTER (n > 2) AS rejected, count(*) FILTER (n <= 2) AS accepted FROM f GROUP BY 1"""
)
def rate_limit_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Two calls in a window that opens with a client's first call; rejected calls count, too."""
    got = A.window_limits(table(spark, d, "events"), "user_id", F.col("ts").cast("timestamp"), 43_200_000_000, 2)
    return got.select("user_id", "rejected", "accepted")


@query(
    """SELECT coalesce(c_custkey, user_id) AS customer, coalesce(nullif(n.name, ''), c_name) AS name, coalesce(n.segment, c_mktsegment) AS segment FROM customer FULL JOIN (
      SELECT user_id, arg_max(CASE WHEN event_type = 'signup' THEN 'user ' || CAST(event_id AS VARCHAR) WHEN event_type = 'view' THEN '' END, (ts, event_id)) FILTER (event_type IN ('signup', 'view')) AS name,
        arg_max(upper(event_type), (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS segment FROM events GROUP BY 1) n ON user_id = c_custkey"""
)
def upsert_customer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Many updates a key fold into the last known values; blanks and nulls erase nothing."""
    kind = F.col("event_type")
    changes = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(kind == "signup", F.concat(F.lit("user "), F.col("event_id").cast("string"))).when(kind == "view", "").alias("name"), F.when(kind.isin("purchase", "error"), F.upper(kind)).alias("segment"))
    new = M.last_known(changes, ["user_id"], ["ts", "event_id"], ["name", "segment"]).withColumnRenamed("user_id", "customer")
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return M.upsert(old, new, ["customer"], ("name",))


@query(
    """SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS metadata FROM (
      SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS v FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Maps merged key by key, later ones winning; merged per key before users are put together."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.get_json_object("props", "$.k"), F.struct("ts", "event_id")).alias("v"))
    return A.ordered(last, ["user_id"], ["event_type"], F.concat_ws("=", "event_type", "v"), "metadata").select("user_id", F.array_join("metadata", ",").alias("metadata"))


@query(
    """SELECT doc_id, score, CASE WHEN score >= 7 THEN 'pass' WHEN doc_id % 2 = 1 THEN 'human' ELSE 'rewrite' END AS verdict FROM (
      SELECT doc_id, least(round((CASE WHEN quality = 1 THEN 9.0 ELSE 5.0 END + doc_id % 4) / 1.0 / 1, 1), CASE WHEN toxic = 1 THEN 4.0 WHEN quality = 0 THEN 6.0 ELSE 10.0 END) AS score FROM labels)"""
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Scores capped by their worst fault; what doesn't pass is rewritten once, then a person decides."""
    base = F.when(F.col("quality") == 1, 9.0).otherwise(5.0) + F.col("doc_id") % 4
    got = R.capped_quality([base, F.lit(float("nan")), F.lit(None).cast("double")], F.col("quality") == 0, F.col("toxic") == 1, attempt=F.col("doc_id") % 2 + 1)
    return table(spark, d, "labels").select("doc_id", got.alias("g")).select("doc_id", "g.score", "g.verdict")


@query(
    """SELECT 'phone_like_name' AS rule, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS violations FROM customer
    UNION ALL SELECT 'negative_balance', count(*) FILTER (c_acctbal < 0) FROM customer
    UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) FROM orders
    UNION ALL SELECT 'discount_range', count(*) FILTER (l_discount < 0 OR l_discount > 0.05) FROM lineitem
    UNION ALL SELECT 'duplicate_line', count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'orphan_customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'orphan_order', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'shipped_before_order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate"""
)
def dq_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a database would enforce, as counts of rows that break it."""
    customer, orders, lines = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    late = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return M.violations([
        ("phone_like_name", customer, ~F.col("c_name").rlike("^Customer#[0-9]{9}$")), ("negative_balance", customer, F.col("c_acctbal") < 0), ("status", orders, ~F.col("o_orderstatus").isin("O", "F", "P")),
        ("discount_range", lines, (F.col("l_discount") < 0) | (F.col("l_discount") > 0.05)), ("duplicate_line", M.duplicates(lines, ["l_orderkey", "l_partkey"]), F.lit(True)),
        ("orphan_customer", M.orphans(orders, "o_custkey", customer, "c_custkey"), F.lit(True)), ("orphan_order", M.orphans(lines, "l_orderkey", orders, "o_orderkey"), F.lit(True)),
        ("shipped_before_order", late, F.col("l_shipdate") < F.col("o_orderdate")),
    ])


@query("SELECT conv_id, CASE WHEN len(list_filter(roles, lambda r: r = 'assistant')) = 0 THEN 'new' WHEN last_role = 'user' THEN 'waiting' ELSE 'answered' END AS status, n FROM (SELECT conv_id, list(role) AS roles, arg_max(role, (turn, role)) AS last_role, count(*) AS n FROM conversations GROUP BY 1)")
def conversation_states(spark: SparkSession, d: str) -> DataFrame:
    """State by conversation, without expiry: from counts and the last turn, no list is gathered."""
    got = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"), F.max_by("role", F.struct("turn", "role")).alias("last_role"), F.count("*").alias("n"))
    return got.select("conv_id", F.when(F.col("a") == 0, "new").when(F.col("last_role") == "user", "waiting").otherwise("answered").alias("status"), "n")


@query("SELECT lang, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) < 200) AS short, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS flagged FROM documents GROUP BY 1")
def ingestion_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A run's outcomes in one pass."""
    flagged = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("flag", F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("k")).join(flagged, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("k") < 200).alias("short"), F.count("flag").alias("flagged"))


@query("SELECT DISTINCT conv_id FROM conversations SEMI JOIN (SELECT conv_id AS c FROM conversations GROUP BY 1 HAVING count(*) > 4) ON conv_id = c")
def long_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 4").select("conv_id")
