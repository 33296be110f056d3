"""Information-theoretic sanitisation of personal data.

Entities (mail addresses, IP addresses, cards, telephone numbers) are found in whole texts. Corpus co-occurrence then
tells how strongly each word next to an entity reveals it: with PMI(entity; term) = log(N * both / (entity * term)),
counted over documents, and IC(entity) = log(N / entity), the disclosure of a term is PMI / IC, which reaches 1 when
the term occurs nowhere without the entity. Terms over REMOVE are removed next to the entity, terms over GENERALISE
are generalised. As most values are in one document only, an entity is protected as a value and as one of its class: a
word that hardly occurs but next to mail addresses reveals that there is one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import full_text, prepare, row_key, written

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that can reveal it.
CONTEXT = 6
#: Documents that must hold entity and term together before their co-occurrence counts as evidence.
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.98

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PARTS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping, in linear time: from each @ with a domain back over the local part."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of a run of dotted numbers, each four in turn; those with a part over 255 are dropped."""
    for run in _DOTTED.finditer(text):
        parts = list(_PARTS.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p := x[0].lstrip("0")) < 4 and int(p or "0") <= 255 for x in four):
                yield four[0].start(), four[3].end()


def numbers(text: str, pattern: re.Pattern, least: int, most: int, luhns: bool) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if least <= len(digits) <= most and (not luhns or luhn(digits)):
            yield m.start(), m.end()


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS, in code points, end exclusive."""
    return [
        list(emails(text)) if "@" in text else [],
        list(addresses(text)),
        list(numbers(text, _CARD, 13, 19, True)),
        list(numbers(text, _PHONE, 9, 15, False)) if "+" in text else [],
    ]


def context_terms(text: str, spans: list[list[tuple[int, int]]], width: int = CONTEXT) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) for the words within `width` words of each entity, other entities left out.

    Each word is given for the entity's value (kind:value) and for its class (kind).
    """
    flat = sorted((s, e) for kind in spans for s, e in kind)
    out = []
    for kind, of_kind in zip(KINDS, spans, strict=True):
        for s, e in of_kind:
            entity = f"{kind}:{text[s:e].lower()}"
            # At most `width` words, looked for in a stretch whose length doesn't depend on the text's.
            lo, hi = max(0, s - 24 * width), min(len(text), e + 24 * width)
            before = [m for m in TERM.finditer(text, lo, s) if m.start() > lo or not lo]
            after = [m for m in TERM.finditer(text, e, hi) if m.end() < hi or hi == len(text)]
            for m in before[-width:] + after[:width]:
                if not any(a < m.end() and m.start() < b for a, b in _near(flat, m.start(), m.end())):
                    out += [(of, m[0].lower(), m.start(), m.end()) for of in (entity, kind)]
    return out


def _near(flat: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    from bisect import bisect_left

    k = bisect_left(flat, (start, start))
    return flat[max(0, k - 4) : k + 4]


_FOUND = (
    "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
    "entities array<string>, terms array<struct<entity:string,term:string,start:int,end:int>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        counts, bases, digests, entities, terms = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            base = ",".join(f"{k}:{s}:{e}" for k, of in zip(KINDS, spans, strict=True) for s, e in of)
            counts.append([len(x) for x in spans])
            bases.append(base)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            found = context_terms(text, spans) if base else []
            terms.append([dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in found])
            entities.append(sorted({x for k, of in zip(KINDS, spans, strict=True) for s, e in of for x in (f"{k}:{text[s:e].lower()}", k)}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
             pa.array(bases, pa.string()), pa.array(digests, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(terms, kind)],
            ["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "terms"],
        )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each term; given out whenever the table gets large."""
    seen: Counter[str] = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(set(TERM.findall(text.lower())))
            if len(seen) > 400_000:
                yield rows()
                seen.clear()
    yield rows()


def disclosures(found: DataFrame, docs: DataFrame, n_docs: int, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure) of the pairs that occur together in `support` documents or more."""
    both = (
        found.select(F.explode(F.array_distinct(F.transform("terms", lambda t: F.struct(t.entity, t.term)))).alias("p"))
        .groupBy("p.entity", "p.term")
        .agg(F.count("*").alias("n_both"))
        .where(F.col("n_both") >= support)
    )
    entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    term = docs.select("text").mapInArrow(_document_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    pmi = F.log(F.lit(float(n_docs)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    ic = F.log(F.lit(float(n_docs)) / F.col("n_entity"))
    value = F.col("entity").contains(":")
    of_values = both.where(value).join(entity.where(value), "entity")
    of_classes = both.where(~value).join(F.broadcast(entity.where(~value)), "entity")  # as many rows as KINDS
    return of_values.unionByName(of_classes).join(term, "term").select("entity", "term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure"))


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts by kind, base spans and all spans with the method's.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined; code points),
    n_generalised, n_removed. A null text counts as empty and has no spans; a null doc_id is kept. Rows that are
    repeated get equal results. Other columns are ignored; an empty table gives none. Whole texts are scanned, in
    linear time; the method's spans lie within CONTEXT words of an entity.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    keyed = docs.select(row_key("doc_id", "text").alias("rid"), "doc_id", "text")
    found = written(keyed.mapInArrow(_find, _FOUND))
    flagged = disclosures(found, docs, found.count(), support).where(F.col("disclosure") >= generalise)
    flagged = flagged.select("entity", "term", (F.col("disclosure") >= remove).alias("remove"))
    marked = (
        found.select("rid", F.explode("terms").alias("t"))
        .select("rid", "t.*")
        .join(flagged, ["entity", "term"])
        .groupBy("rid", "start", "end")
        .agg(F.max("remove").alias("remove"))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("remove", "start", "end"))).alias("more"))
    )
    said = F.transform("more", lambda m: F.concat(F.when(m["remove"], "removed").otherwise("generalised"), F.lit(":"), m["start"], F.lit(":"), m["end"]))
    n = lambda which: F.coalesce(F.size(F.filter("more", lambda m: m["remove"] == which)), F.lit(0)).cast("long")
    return found.join(marked, "rid", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(said, ",")).alias("spans"),
        F.when(F.col("more").isNull(), 0).otherwise(n(False)).cast("long").alias("n_generalised"),
        F.when(F.col("more").isNull(), 0).otherwise(n(True)).cast("long").alias("n_removed"),
    )


def sanitised(text: str, spans: str) -> str:
    """The text with its spans replaced: entities and generalised terms by their kind, removed terms by nothing."""
    if not spans:
        return text
    out, last = [], 0
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))), key=lambda x: x[1:]):
        if s >= last:
            out += [text[last:s], "" if kind == "removed" else f"[{'TERM' if kind == 'generalised' else kind.upper()}]"]
            last = e
    return "".join([*out, text[last:]])
