"""Money, phones and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTRY_CODE = "92"


def phone(raw: Column) -> Column:
    """E.164, or null if the number can't be told."""
    kept = F.regexp_replace(raw, r"[^0-9+]", "")
    kept = F.when(kept.startswith("00"), F.concat(F.lit("+"), F.substring(kept, F.lit(3), F.length(kept)))).otherwise(kept)
    digits = F.regexp_replace(kept, r"[^0-9]", "")
    return (
        F.when(kept.startswith("+"), F.when(kept.rlike(r"^\+[1-9][0-9]{7,14}$"), kept))
        .when(digits.startswith(COUNTRY_CODE) & (F.length(digits) == 12), F.concat(F.lit("+"), digits))
        .when(digits.startswith("0") & (F.length(digits) == 11), F.concat(F.lit("+" + COUNTRY_CODE), F.substring(digits, F.lit(2), F.length(digits))))
        .when((F.length(digits) == 10) & ~digits.startswith("0"), F.concat(F.lit("+" + COUNTRY_CODE), digits))
    )


def phone_display(e164: Column) -> Column:
    return F.when(e164.startswith("+" + COUNTRY_CODE) & (F.length(e164) == 13), F.concat_ws(" ", F.substring(e164, 1, 3), F.substring(e164, 4, 3), F.substring(e164, 7, 20))).otherwise(e164)


def phone_in(text: Column) -> Column:
    """The first run in a text that looks like a phone number, normalised."""
    return phone(F.nullif(F.regexp_extract(text, r"(\+?[0-9][0-9\s-]{8,16}[0-9])", 1), F.lit("")))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def budget(raw: Column) -> Column:
    """Whole amount of a spoken or typed budget: 2 lakh, 1 crore, 200k, Rs. 200,000; else null."""
    t = F.trim(F.regexp_replace(F.lower(raw), r"rs\.?|pkr|rupees?", ""))
    lakh, crore, k = (_number(t, p) for p in (r"([0-9.]+)\s*(?:lakhs|lakh|lac)", r"([0-9.]+)\s*crore", r"([0-9.]+)\s*k\b"))
    plain = _number(F.regexp_replace(t, r"[,\s]", ""), r"([0-9]+(?:\.[0-9]+)?)")
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    return F.when(t.rlike(r"[0-9.]+\s*(?:lakhs|lakh|lac)"), half_up(lakh * 100_000)).when(t.rlike(r"[0-9.]+\s*crore"), half_up(crore * 10_000_000)).when(t.rlike(r"[0-9.]+\s*k\b"), half_up(k * 1_000)).otherwise(half_up(plain))


def budget_in(text: Column) -> Column:
    """A budget stated in a text: after a word like budget or under, after a currency, or with a scale."""
    amount = r"(?:(?:rs\.?|pkr)?\s?[0-9][0-9,.\s]*\s*(?:k\b|lakhs|lakh|lac|crore)?)"
    found = [
        F.regexp_extract(text, rf"(?i)\b(?:budget|afford|spend|spending|price range|under|below|around|about|up\s?to|maximum|max)\b[^0-9]{{0,24}}({amount})", 1),
        F.regexp_extract(text, r"(?i)\b(?:rs\.?|pkr)\s?([0-9][0-9,.\s]*\s*(?:k\b|lakh|lac|crore)?)", 1),
        F.regexp_extract(text, r"(?i)\b([0-9.]+\s*(?:k|lakhs|lakh|lac|crore)\b)", 1),
    ]
    # of an array, so that the amounts are one expression
    amounts = F.transform(F.array(*found), lambda x: budget(F.nullif(x, F.lit(""))))
    return F.get(F.filter(amounts, lambda b: b > 0), F.lit(0))


def money(raw: Column) -> Column:
    """Digits and points of a cell as a number; 0 if there is none. Signs are dropped."""
    kept = F.regexp_replace(raw, r"[^0-9.]", "")
    return F.coalesce(_number(kept, r"^([0-9]*\.?[0-9]+|[0-9]+\.?)"), F.lit(0.0))


def rupees(amount: Column) -> Column:
    return F.when(amount.isNull(), F.lit("N/A")).otherwise(F.concat(F.lit("Rs. "), F.format_number(F.floor(amount + 0.5), 0)))


def spoken_amount(amount: Column) -> Column:
    """2 lakh 50 thousand: greedy parts of crore, lakh, thousand and the rest."""
    n = F.floor(amount + 0.5).cast("long")
    parts = [(F.floor(n / 10_000_000), "crore"), (F.floor(n % 10_000_000 / 100_000), "lakh"), (F.floor(n % 100_000 / 1_000), "thousand")]
    rest = n % 1_000
    said = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("string"), F.lit(f" {name}"))) for v, name in parts], F.when(rest > 0, rest.cast("string")))
    return F.when(n == 0, F.lit("zero")).otherwise(said)


def spoken_digits(text: Column) -> Column:
    """UC-104 -> U C 1 0 4."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]", ""), r"(.)", "$1 "))


def days_since(then: Column, now: Column) -> Column:
    """Whole days that have passed."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def days_until(then: Column, now: Column) -> Column:
    """Days to go, a begun day counts whole; negative once a whole day has passed."""
    return F.ceil((F.unix_micros(then.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def reference(prefix: str, number: Column, width: int) -> Column:
    """LEAD-0042; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))
