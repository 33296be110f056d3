"""JSON expressions: model answers to rows, canonical form, digests. Items are read as variants, so that numbers, texts and booleans stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "(?s)```(?:json)?\\s*(.*?)```"


def json_body(raw: Column) -> Column:
    """The JSON in an answer: itself, the first fenced block, even an empty one, the widest braces, or else the raw text."""
    bare = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    text = bare(raw)
    braces = F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)
    return F.when(text.rlike("^[\\[{]"), text).when(raw.rlike(FENCE), bare(F.regexp_extract(raw, FENCE, 1))).when(braces != "", braces).otherwise(text)


def is_list(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def member(value: Column, name: str) -> Column:
    """A member of an object, null where there is none."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def elements(value: Column) -> Column:
    """The elements of a list; null for anything else."""
    return F.when(is_list(value), F.try_variant_get(value, "$", "array<variant>"))


def integer(value: Column) -> Column:
    """Numbers without their fraction, booleans as 0 and 1, texts of digits; null for anything else."""
    return F.try_variant_get(value, "$", "bigint")


def text_of(value: Column) -> Column:
    """A text as it is, booleans and null as their words, other values as JSON; an absent value is empty."""
    kind, said = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return F.when(value.isNull(), "").when(kind == "BOOLEAN", F.initcap(said)).when(kind == "VOID", "None").otherwise(said)


def truthy(value: Column) -> Column:
    """False for an absent value, null, false, zero, and empty texts, lists and objects; true for all others, "false" too."""
    kind, said = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    some = F.when(kind == "STRING", said != "").when(kind == "BOOLEAN", said == "true").when(kind == "VOID", False).when(is_list(value), said != "[]").when(is_object(value), said != "{}")
    return F.coalesce(some.otherwise(number != 0), F.lit(False))


def listed(raw: Column, field: str) -> Column:
    """Elements of {"field": [...]} or of a bare list; null for broken JSON and for anything else."""
    value = F.try_parse_json(raw)
    return elements(F.when(is_object(value), member(value, field)).otherwise(value))


def once(value: Column, use) -> Column:
    """use(value), with value computed once; an expression within a lambda would be computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_of_each(items: Column, key: str) -> Column:
    """Of items with one key the last, in the items' order; no key is null. Places are sorted by key, so time is not quadratic."""

    def lasts(items: Column) -> Column:
        by_key = F.array_sort(F.transform(items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"))))
        places = once(by_key, lambda s: F.filter(s, lambda x, j: ~(F.get(s, j + 1)["k"].eqNullSafe(x["k"]))))
        return F.transform(F.array_sort(F.transform(places, lambda x: x["i"])), lambda i: F.get(items, i))

    return once(items, lasts)


def rerank_scores(raw: Column, n: Column, top: int = 3, strict: bool = False) -> Column:
    """map of ordinal (1 to n) to score (0 to top): items that can't be read are left out, the last of one ordinal holds.

    Null where the answer is broken, is no list or scores no candidate; with strict that is an error, as a rerank can't
    go on without one.
    """
    read = F.transform(F.filter(listed(raw, "scores"), is_object), lambda x: F.struct(integer(member(x, "id")).alias("id"), integer(member(x, "score")).alias("score")))
    known = last_of_each(F.filter(read, lambda x: x["id"].between(1, n) & x["score"].isNotNull()), "id")
    scores = F.map_from_entries(F.transform(known, lambda x: F.struct(x["id"].cast("int"), F.least(F.greatest(x["score"], F.lit(0)), F.lit(top)).cast("int"))))
    found = F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, scores)
    failed = F.raise_error(F.concat(F.lit("no candidate was scored: "), F.substring(F.coalesce(raw, F.lit("")), 1, 200)))
    return F.coalesce(found, failed.cast("map<int,int>")) if strict else found


#: Control characters that Spark writes with capital hex digits; the canonical form has small ones.
_HEX = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))


def canonical(**fields: Column) -> Column:
    """JSON with sorted keys and no blanks; nulls are written."""
    out = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    small = out
    for code in _HEX:
        small = F.regexp_replace(small, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u00{code:02X}", f"$1\\\\u00{code:02x}")
    return F.when(out.rlike("\\\\u00[01][A-F]"), small).otherwise(out)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
