"""Filter interaction audit: five filters in all orders, duplicates found by radix tries over ranges of adaptive text prefixes."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import WORD_SPLIT, full_text, prepare

FILTERS = "ABCDE"
#: Text bytes that a range, and so a trie, is made for; sampled texts a range (they set boundaries, never a result); bytes of the
#: sample that one task sorts; text bytes that a map task gathers before it sends its distinct texts on.
RANGE_BYTES, SAMPLES, SORTED, GATHER = 32 << 20, 16, 128 << 20, 64 << 20
_BLANKS = " \t\n\x0b\x0c\r"


class Trie:
    """A compressed radix trie over bytes: a node is [label, children by first byte, value]; terminals hold the least value."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, text: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, value]
                self.bytes += len(text) - at
                return
            label = child[0]
            if not text.startswith(label, at):
                n = shared(label, text, at)
                upper = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                node[1][text[at]] = child = upper
                label = upper[0]
            node, at = child, at + len(label)
        if node[2] is None or value < node[2]:
            node[2] = value

    def terminals(self) -> Iterator[tuple[bytes, tuple]]:
        """All texts and their values; a walk with a stack, as tries can be deep."""
        stack = [(b"", self.root)]
        while stack:
            before, (label, children, value) = stack.pop()
            text = before + label
            if value is not None:
                yield text, value
            stack.extend((text, c) for c in children.values())

    def values(self) -> Iterator[tuple]:
        stack = [self.root]
        while stack:
            _, children, value = stack.pop()
            if value is not None:
                yield value
            stack.extend(children.values())


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a and b[at:] have in common from their starts, by halving; most compares are of whole slices."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def separators(rows: DataFrame, ranges: int, texts: int) -> list[bytes]:
    """Boundaries between ranges of texts (rows: text): the shortest prefixes that tell neighbours of a sorted sample apart.

    The sample is by the text's hash, so copies count once; a prefix is as long as the texts beside it make it, also
    where a third of all texts begin alike. Of SAMPLES neighbours the shortest prefix is taken and sent to the driver.
    The sample is sorted in as few tasks as SORTED allows, as Spark sends some texts for each to the driver.
    """
    rate = max(1, texts // (ranges * SAMPLES))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0).select(F.col("text").cast("binary").alias("text")).distinct()
    sample = sample.repartitionByRange(max(1, ranges * RANGE_BYTES // (rate * SORTED)), "text").sortWithinPartitions("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, seen, out = None, None, 0, []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if last is not None and text != last:
                    prefix = text[: shared(last, text, 0) + 1]
                    best, seen = prefix if best is None or len(prefix) < len(best) else best, seen + 1
                    if seen == SAMPLES:
                        out.append(best)
                        best, seen = None, 0
                last = text
        yield pa.RecordBatch.from_arrays([pa.array(out + [best] * (best is not None), pa.binary())], ["prefix"])

    return sorted({bytes(r["prefix"]) for r in sample.mapInArrow(cut, "prefix binary").collect()})


def first_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2): for each distinct text the least doc_id that has it, with two hashes of the text; null ids are left out.

    Map tasks insert their texts into a trie and send each distinct one on once, so large groups of copies shrink before
    the shuffle. Ranges bounded by `separators` go to a task each, whose trie takes the whole texts.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    ranges = max(1, -(-(size["b"] or 0) // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = separators(rows, ranges, size["n"])

    def sent(trie: Trie) -> pa.RecordBatch:
        texts, values = zip(*trie.terminals(), strict=True) if trie.root[1] or trie.root[2] else ((), ())
        columns = [pa.array([v[i] for v in values], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, t) for t in texts], pa.int32()), *columns, pa.array(texts, pa.binary())], ["range", "doc_id", "k1", "k2", "text"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for text, *value in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "k1", "k2")), strict=True):
                trie.insert(text, tuple(value))
                if trie.bytes > GATHER:
                    yield sent(trie)
                    trie = Trie()
        yield sent(trie)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for text, *value in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "k1", "k2")), strict=True):
                trie.insert(text, tuple(value))
        values = list(trie.values())
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], pa.int64()) for i in range(3)], ["doc_id", "k1", "k2"])

    keyed = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.col("text").cast("binary").alias("text"))
    dealt = keyed.mapInArrow(gathered, "range int, doc_id long, k1 long, k2 long, text binary")
    return dealt.repartitionById(len(bounds) + 1, "range").drop("range").mapInArrow(firsts, "doc_id long, k1 long, k2 long")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, A lowest."""
    words = F.split(F.btrim(text, F.lit(_BLANKS)), WORD_SPLIT)
    blank = F.btrim(text, F.lit(_BLANKS)) == ""
    n = F.when(blank, 0).otherwise(F.size(words))
    distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct(words)))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 200, 100 * distinct.cast("long") < 50 * n, 100 * upper.cast("long") > 3 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail, as bits, and by their labels.

    Of several label rows for a document the highest values hold. Keys and masks are joined, never texts; texts are
    shuffled once, in `first_copies`.
    """
    text = full_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    firsts = first_copies(docs).withColumn("first", F.lit(True))
    joined = rows.join(marks, "doc_id", "left").join(firsts, ["doc_id", "k1", "k2"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return joined.groupBy("part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count("*").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of docs (doc_id, text, lang).

    One row for each part, order and step. Null texts count as empty and are equal to empty ones; a null lang is the
    part ''; a null doc_id has no smaller one, is no copy and makes none; repeated rows of one doc_id are no copies of
    each other; labels of null or other ids are ignored; other columns are ignored; an empty table has no parts.
    """
    prepare(docs.sparkSession)
    masks = failure_masks(docs, labels)
    steps = [(o, s + 1, 1 << FILTERS.index(o[s]), sum(1 << FILTERS.index(f) for f in o[:s])) for o in map("".join, permutations(FILTERS)) for s in range(len(FILTERS))]
    every = F.from_json(F.lit(json.dumps([dict(zip(("o", "s", "own", "before"), x, strict=True)) for x in steps])), "array<struct<o:string,s:int,own:int,before:int>>")
    rows = masks.select("*", F.explode(every).alias("x"))
    own, before, mask, n = F.col("x.own"), F.col("x.before"), F.col("mask"), F.col("n")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda when: F.sum(F.when(when, n).otherwise(0)).cast("long")
    lost = fails & ~gone
    orders = F.when(fails, n * F.expr("120 div bit_count(mask)")).otherwise(0)  # a document falls to each filter that it fails in equally many orders
    return rows.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step")).agg(
        total(~fails & ~gone).alias("kept"), total(lost).alias("removed"), total(fails & gone).alias("redundant"), total(mask == own).alias("unique_fails"),
        total(lost & F.col("good")).alias("good_lost"), total(lost & F.col("toxic")).alias("toxic_lost"), F.sum(orders).cast("long").alias("shapley"),
    )


_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
AUDIT_SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, len({_W}) AS n, len(list_distinct({_W})) AS u FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [n < 200, 100 * u < 50 * n, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, fails, count(*) AS n, len([x FOR x IN fails IF x]) AS k FROM f GROUP BY part, good, toxic, fails),
i AS (SELECT unnest(range(1, 6)) AS i), o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order, i::INTEGER AS step, o[i] AS own, o[1:i - 1] AS before FROM o, i),
x AS (SELECT part, filter_order, step, good, toxic, n, k, fails[own] AS fail, len([b FOR b IN before IF fails[b]]) > 0 AS gone FROM m, s)
SELECT part, filter_order, step, (coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (fail AND NOT gone), 0))::BIGINT AS removed, (coalesce(sum(n) FILTER (fail AND gone), 0))::BIGINT AS redundant,
  (coalesce(sum(n) FILTER (fail AND k = 1), 0))::BIGINT AS unique_fails, (coalesce(sum(n) FILTER (fail AND NOT gone AND good), 0))::BIGINT AS good_lost, (coalesce(sum(n) FILTER (fail AND NOT gone AND toxic), 0))::BIGINT AS toxic_lost,
  (coalesce(sum(n * 120 // greatest(k, 1)) FILTER (fail), 0))::BIGINT AS shapley FROM x GROUP BY part, filter_order, step"""
