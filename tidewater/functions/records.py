"""JSON records: strict shapes, containment, redaction."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from . import values as V

# Names of fields whose values are hidden, or shown in part, and how long and how many values may be.
SECRET = (
    "password", "token", "apikey", "api_key", "secret", "authorization", "auth", "servicerolekey", "service_role_key", "anonkey", "signature",
    "credential", "bearer", "cookie", "set-cookie", "x-api-key", "x-vapi-secret",
)
PERSONAL = ("phone", "email", "delivery_address", "deliveryaddress", "address")
MOST_CHARS, MOST_ITEMS = 600, 50


@dataclass(frozen=True)
class Field:
    """What a field of a request may hold: text of a length, a number within a range, one of some words, or a phone number."""

    kind: str = "text"
    required: bool = False
    least: float = 0
    most: float = float("inf")
    one_of: tuple[str, ...] = ()


CHANNELS = ("web_chat", "whatsapp", "instagram", "voice", "email")
CHAT = {"message": Field(required=True, least=1, most=4000), "sessionId": Field(required=True, least=1, most=128), "channel": Field(one_of=CHANNELS), "phone": Field("phone"), "name": Field(least=1, most=120), "metadata": Field("any")}
SEARCH = {"query": Field(required=True, least=1, most=500), "topK": Field("number", least=1, most=20)}


def problems(record: Column, shape: dict[str, Field]) -> Column:
    """array<string>: unknown fields, then what is wrong with each field, in the shape's order; of no object, 'not an object'."""
    names = F.json_object_keys(record)
    unknown = F.transform(F.array_sort(F.array_except(names, F.array(*map(F.lit, shape)))), lambda k: F.concat(F.lit("unknown field "), k))
    found = []
    for name, f in shape.items():
        raw = F.trim(F.get_json_object(record, f"$.{name}"))
        if f.kind == "number":
            n = raw.try_cast("double")
            bad = n.isNull() | (n != F.floor(n)) | (n < f.least) | (n > f.most)
        elif f.kind == "phone":
            bad = V.phone(raw).isNull()
        elif f.kind == "any":
            bad = F.lit(False)
        else:
            bad = (F.length(raw) < f.least) | (F.length(raw) > f.most)
        if f.one_of:
            bad = bad | ~raw.isin(*f.one_of)
        missing = F.when(raw.isNull(), f"{name} is required") if f.required else F.lit(None).cast("string")
        found.append(F.coalesce(missing, F.when(F.coalesce(bad & raw.isNotNull(), F.lit(False)), f"{name} is not valid")))
    return F.when(names.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(unknown, F.array_compact(F.array(*found))))


def contains(record: Column, fragment: dict) -> Column:
    """Whether the JSON record holds every value of the fragment, at its place; an empty fragment is in every object."""
    hit = F.json_object_keys(record).isNotNull()

    def look(part: dict, path: str) -> None:
        nonlocal hit
        for k, v in part.items():
            at = f"{path}['{k}']"
            got = F.get_json_object(record, at)
            if isinstance(v, dict):
                hit = hit & F.json_object_keys(got).isNotNull()
                look(v, at)
            else:
                text = v if isinstance(v, str) else json.dumps(v)
                hit = hit & (got == text)

    look(fragment, "$")
    return F.coalesce(hit, F.lit(False))


def _bare(name: str) -> str:
    return re.sub("[-_]", "", name.lower())


def masked(value: Column) -> Column:
    """+92300****567, a***@b.com; up to six characters are starred whole."""
    local, domain = F.split(value, "@")[0], F.get(F.split(value, "@"), F.lit(1))
    stars = lambda n: F.repeat(F.lit("*"), F.greatest(F.lit(1), n))
    n = F.length(value)
    return F.when(value.contains("@"), F.concat(F.left(local, F.lit(1)), stars(F.length(local) - 1), F.lit("@"), domain)).when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(5)), stars(n - 8), F.right(value, F.lit(3))))


def _redacted(value: Column, kind: DataType, name: str) -> Column:
    if any(_bare(s) in _bare(name) for s in SECRET):
        return F.when(value.isNotNull(), F.lit("[REDACTED]"))
    if isinstance(kind, StructType):
        inner = F.struct(*[_redacted(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(F.slice(value, 1, MOST_ITEMS), lambda x: _redacted(x, kind.elementType, name))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        bare = lambda k: F.regexp_replace(F.lower(k), "[-_]", "")
        secret = lambda k: bare(k).rlike("|".join(re.escape(_bare(s)) for s in SECRET))
        if isinstance(kind.valueType, StringType):
            return F.transform_values(value, lambda k, v: F.when(secret(k), F.when(v.isNotNull(), "[REDACTED]")).when(bare(k).isin(*map(_bare, PERSONAL)), masked(v)).otherwise(_redacted(v, kind.valueType, "")))
        return F.transform_values(F.map_filter(value, lambda k, v: ~secret(k)), lambda k, v: _redacted(v, kind.valueType, ""))
    if isinstance(kind, StringType):
        if _bare(name) in map(_bare, PERSONAL):
            return masked(value)
        return F.when(F.length(value) > MOST_CHARS, F.concat(F.left(value, F.lit(MOST_CHARS)), F.lit("\u2026[truncated]"))).otherwise(value)
    return value


def redact(rows: DataFrame) -> DataFrame:
    """rows safe to log: at any depth of structs, arrays and maps, secrets are replaced, personal data masked, long texts and lists cut.

    Of maps whose values aren't text, secret entries are left out.
    """
    return rows.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in rows.schema])


def picked(properties: Column, names: tuple[str, ...]) -> Column:
    """The first of the named entries of a map<string,string>, whatever their case, that isn't blank."""
    low = F.map_from_entries(F.transform(F.map_entries(properties), lambda e: F.struct(F.lower(F.trim(e["key"])), e["value"])))
    return F.coalesce(*[F.nullif(F.trim(low[n.lower()]), F.lit("")) for n in names])
