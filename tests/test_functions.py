"""Scalar rules against tables of expected values."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewater.functions import records as J
from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.functions import values as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("said", "want"),
    [("0300 1234567", "+923001234567"), ("+92 300 1234567", "+923001234567"), ("0092-300-1234567", "+923001234567"), ("923001234567", "+923001234567"), ("300 1234567", "+923001234567"), ("(0300) 123-4567", "+923001234567"), ("123", None), ("03001", None), ("+1234567890123456", None), (None, None)],
)
def test_phone(spark, said, want):
    assert one(spark, said, V.phone) == want


@pytest.mark.parametrize(("said", "want"), [("2 lakh", 200000), ("2.5 lakh", 250000), ("200k", 200000), ("1 crore", 10000000), ("Rs. 200,000", 200000), (None, None), ("none", None), ("", None)])
def test_budget(spark, said, want):
    assert one(spark, said, V.budget) == want


@pytest.mark.parametrize(("said", "want"), [("I want an iPhone 15, budget 2 lakh", 200000), ("iPhone 15", None), ("around Rs. 45,000 please", 45000), ("PKR 30000", 30000)])
def test_budget_in_text(spark, said, want):
    assert one(spark, said, V.budget_in) == want


@pytest.mark.parametrize(("said", "want"), [("-$1,200.50", 1200.5), ("n/a", 0.0), ("12.", 12.0), (".5", 0.5)])
def test_money(spark, said, want):
    assert one(spark, said, V.money) == want


def test_spoken(spark):
    assert one(spark, "12345678", lambda x: V.spoken_amount(x.cast("long"))) == "1 crore 23 lakh 45 thousand 678"
    assert one(spark, "0", lambda x: V.spoken_amount(x.cast("long"))) == "zero"
    assert one(spark, "UC-104", V.spoken_digits) == "U C 1 0 4"
    assert one(spark, "1234", lambda x: V.reference("A-", x.cast("int"), 3)) == "A-1234"
    assert one(spark, "7", lambda x: V.reference("A-", x.cast("int"), 3)) == "A-007"
    assert one(spark, "274998", lambda x: V.rupees(x.cast("double"))) == "Rs. 274,998"


@pytest.mark.parametrize(("a", "b"), [("cancellation", "cancel"), ("returns", "return"), ("warranties", "warranty"), ("shipping", "ship"), ("headphones", "headphone"), ("boxes", "box")])
def test_stem(spark, a, b):
    assert one(spark, a, T.stem) == one(spark, b, T.stem) == b


def test_clean(spark):
    got = one(spark, "war-\nranty \\*bold\\* “x”\r\nPage 3 of 9\n\n\n\nend  of   line  ", T.clean)
    assert got == 'warranty *bold* "x"\n\nend of line'


def test_sentences(spark):
    assert one(spark, "It costs Rs. 500. Pay now! e.g. Cash. ok then. 2 days", T.sentences) == ["It costs Rs. 500.", "Pay now! e.g. Cash. ok then.", "2 days"]


def test_claims(spark):
    row = spark.createDataFrame([("Refund in 14 days, Rs. 200,000 or 5%", "within 14 days you get 200000")], "a string, e string")
    assert row.select(T.unsupported_claims(F.col("a"), F.col("e")).alias("c")).first().c == []
    row = spark.createDataFrame([("Refund in 30 days", "within 14 days")], "a string, e string")
    assert row.select(T.unsupported_claims(F.col("a"), F.col("e")).alias("c")).first().c == ["30 days"]


def plain_html(page):
    """The rules as Python's own regular expressions tell them, one after the other."""
    steps = [(r"(?is)<(script|style)\b.*?</\1>", ""), (r"(?s)<!--.*?-->", ""), *((rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)), (r"(?i)<li[^>]*>", "\n- "), (r"(?i)</t[dh]>", " | ")]
    steps += [(r"(?i)<br[ \t\n\x0b\f\r]*/?>", "\n"), (r"(?i)</(p|div|h[1-6]|tr|table|ul|ol|section|article)>", "\n\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    steps += [(r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")]
    for pattern, put in steps:
        page = re.sub(pattern, lambda m, put=put: put, page)
    return page.strip(" \t\n\x0b\f\r")


def test_html_of_whatever_is_left_open(spark):
    rng = random.Random(4)
    bits = ["<script>", "</script>", "<STYLE a>", "</style>", "<script", "<style ", "<!--", "-->", "<h1", "<h2>", ">", "<", "<li>", "x", " ", "\n", "</p>", "<br />", "&lt;", "sty", "<a b", "<>", "le>", "\r"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.html_to_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert [(a, b) for a, b, t in zip(got, map(plain_html, texts), texts, strict=True) if a != b][:3] == []


@pytest.mark.parametrize("bit", ["<", "<script ", "<!--", "<style", "<h1", "<li <br", "\r", "<script><style>", " \n", "</script", "<a href='"])
def test_html_takes_linear_time(spark, bit):
    page = bit * (1_000_000 // len(bit))
    began = time.time()
    got = spark.createDataFrame([(page,), (page + "> end",)], "t string").select(F.length(T.html_to_text(F.col("t"))).alias("n")).collect()
    assert time.time() - began < 30 and len(got) == 2


def test_html(spark):
    got = one(spark, "<h2>A &amp; B</h2><p>x<br>y</p><ul><li>one<li>two</ul><table><tr><td>c</td><td>d</td></tr></table><script>no()</script>", T.html_to_text)
    assert got.splitlines()[0] == "## A & B" and "- one" in got and "c | d |" in got and "no()" not in got


def test_short_texts(spark):
    assert one(spark, "hello wonderful world", lambda x: T.truncate_words(x, 16)) == "hello wonderful…"
    assert one(spark, "abcdef", T.mask) == "ab**ef"
    assert one(spark, "12 A St, Block 4, Lahore, Punjab", T.redact_address) == "Lahore, Punjab"
    assert one(spark, "R&D  Team!", T.slug) == "r-and-d-team"
    assert one(spark, "in_progress", T.display) == "In progress"


@pytest.mark.parametrize(
    ("said", "want"),
    [("I want to speak to a human", "handoff"), ("my laptop arrived broken", "complaint"), ("where is UC-10452", "order_status"), ("I want to buy, budget 2 lakh", "lead_capture"), ("what is the return policy", "policy_question"), ("what is the price", "price_inquiry"), ("do you have it in stock", "availability_inquiry"), ("hello", "greeting")],
)
def test_intent(spark, said, want):
    assert one(spark, said, lambda x: R.intent(x)["intent"]) == want


def test_lead_scores(spark):
    x = spark.range(1)
    score = lambda *a: x.select(R.lead_score(*a).alias("s")).first().s
    yes, no = F.lit(True), F.lit(False)
    assert score(F.lit(200000), F.lit("considering"), yes, yes, no, yes) == 71
    assert score(F.lit(20000), F.lit("considering"), yes, yes, no, yes) == 43
    assert score(F.lit(200000), F.lit("considering"), yes, yes, no, no) == 35
    assert not x.select(R.high_value(F.lit(900000), F.lit(100), no).alias("h")).first().h
    assert x.select(R.simple_lead_score(F.lit("High"), F.lit(8000), F.lit("LinkedIn")).alias("s")).first().s == 75
    risk, status = R.expense(F.lit(750), F.lit(False))
    assert tuple(x.select(risk, status).first()) == ("High", "Receipt Required")


@pytest.mark.parametrize(("said", "intent", "severity"), [("I was charged twice", "Duplicate Payment", "High"), ("total outage", "Technical Issue", "Critical"), ("this is ridiculous", "Angry Customer", "Critical"), ("forgot my password", "Password Problem", "Medium"), ("good day", "General Enquiry", "Low")])
def test_router(spark, said, intent, severity):
    got = one(spark, said, R.route)
    assert (got.intent, got.severity) == (intent, severity)


def test_suggested_intent(spark):
    row = spark.createDataFrame([("good day", "Billing Question"), ("this is ridiculous", "Billing Question"), ("good day", "Nonsense")], "x string, s string")
    assert [r.i for r in row.select(R.route(F.col("x"), F.col("s"))["intent"].alias("i")).collect()] == ["Billing Question", "Angry Customer", "General Enquiry"]


def test_guard_and_quality(spark):
    assert [one(spark, a, R.guard) for a in ("create task | x", "delete everything", "Create_Task_refund", "dance")] == ["approved", "blocked", "blocked", "blocked"]
    x = spark.range(1)
    got = x.select(R.capped_quality([F.lit(9.0), F.lit(8.0), F.lit(float("nan"))], F.lit(False), F.lit(False)).alias("g")).first().g
    assert (got.score, got.verdict) == (8.5, "pass")
    assert x.select(R.capped_quality([F.lit(9.0)], F.lit(False), F.lit(True), attempt=F.lit(2)).alias("g")).first().g.verdict == "human"
    assert x.select(R.capped_quality([F.lit(None).cast("double")], F.lit(False), F.lit(False)).alias("g")).first().g.verdict == "rewrite"


def test_document_types(spark):
    assert one(spark, "Can I return it and is there a warranty?", R.document_types) == ["return_policy", "warranty_policy"]
    assert one(spark, "what time is it", R.document_types) is None


@pytest.mark.parametrize(("said", "want"), [("Crème brûlée & Co", "creme-brulee-and-co"), ("Ångström  Łódź", "angstrom-odz"), ("e\u0301te\u0301", "ete"), ("--", "")])
def test_slug(spark, said, want):
    assert one(spark, said, T.slug) == want


def test_rank_of_words(spark):
    """A word's k-th occurrence counts 1 / k^2; the sum is shared by the words asked for."""
    got = spark.createDataFrame([([1], 1), ([2, 1], 4), ([], 2)], "c array<int>, n int").select(R.text_rank(F.col("c"), F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == pytest.approx([0.1 / 1.64493406685, 0.1 * 2.25 / 1.64493406685 / 4, 0.0])


def test_contains_any_takes_terms_literally(spark):
    assert [one(spark, x, lambda c: T.contains_any(c, ("a.b", "c+", "can't"))) for x in ("xa.bx", "aXb", "c+", "cc", "I can't")] == [True, False, True, False, True]
    assert one(spark, "x", lambda c: T.contains_any(c, ())) is False


@pytest.mark.parametrize(
    ("record", "fragment", "want"),
    [('{"a":1,"b":{"c":"x","d":2}}', {"b": {"c": "x"}}, True), ('{"a":1,"b":{"c":"x"}}', {"a": 1, "b": {"c": "y"}}, False), ('{"a":1}', {}, True), ("[1]", {}, False), ('{"a":true}', {"a": True}, True), ('{"b":1}', {"b": {"c": 1}}, False), (None, {"a": 1}, False)],
)
def test_containment(spark, record, fragment, want):
    assert one(spark, record, lambda c: J.contains(c, fragment)) is want


@pytest.mark.parametrize(
    ("record", "want"),
    [('{"query":"x","topK":3}', []), ('{"query":"x","topK":3.5}', ["topK is not valid"]), ('{"query":"x","topK":99,"k":1}', ["unknown field k", "topK is not valid"]), ("{}", ["query is required"]), (None, ["not an object"])],
)
def test_strict_shapes(spark, record, want):
    assert one(spark, record, lambda c: J.problems(c, J.SEARCH)) == want


def test_redaction_at_any_depth(spark):
    rows = spark.createDataFrame(
        [("x" * 700, "+923001234567", [("k1", {"x-api-key": "v", "email": "ab@c.d", "note": "n"})] * 60, {"auth": 1, "n": 2})],
        "note string, phone string, calls array<struct<apiKey: string, headers: map<string,string>>>, counts map<string,int>",
    )
    got = J.redact(rows).first()
    assert len(got.note) == 600 + len("\u2026[truncated]") and got.phone == "+9230*****567" and len(got.calls) == 50
    assert got.calls[0].apiKey == "[REDACTED]" and got.calls[0].headers == {"x-api-key": "[REDACTED]", "email": "a*@c.d", "note": "n"} and got.counts == {"n": 2}
    assert [one(spark, v, J.masked) for v in ("123456", "a@b.com", None)] == ["******", "a*@b.com", None]


def test_picked_property(spark):
    got = spark.createDataFrame([({" Due Date ": "2024", "Name": " "},)], "p map<string,string>").select(J.picked(F.col("p"), ("name", "DUE DATE")).alias("x")).first().x
    assert got == "2024"


def test_people_and_products_of_nothing(spark):
    assert one(spark, None, R.person_name) is None and one(spark, None, R.product_query) is None and one(spark, None, T.listed) == []


def test_stems_of_single_words(spark):
    """stem_of() is what the column gives, on endings in all combinations and lengths."""
    rng = random.Random(3)
    ends = [s for s, _ in T.SUFFIXES] + ["ate", "ated", "bb", "tting", "nned", "sses", "xes", "zes", "ches", "shes", "es", "s", "ss", "\u00e9s", ""]
    words = ["".join(rng.choice("abst\u00f1\U00020000") for _ in range(n)) + a + b for n in range(7) for a in ends for b in ends]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert len(got) == len(words) and all(T.stem_of(r.w) == r.s for r in got)
