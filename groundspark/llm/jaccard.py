"""Exact Jaccard join on word shingles by vertical partitioning of the global shingle order.

The global order (a hash, with frequent shingles last) is cut into FRAGMENTS ranges of the hash. A document's first
shingles, as many as a partner must meet, give candidates; parity bits of each fragment bound from above what two
documents share in it, and drop the pairs whose bounds don't sum to the similarity. What is left is counted by fragment:
a document's shingles in a fragment are a row of their own, overlaps are counted where rows of the same fragment meet,
and the parts are summed per pair. Groups of near copies are never expanded into all pairs: each shingle's documents are
held against one leader first, and only pairs that those links leave in different components are compared after that,
where the bounds allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import Words, components, free_names, full_text, grams, mixed, prepare, sequence_hashes, signed, slices, text_bytes, written

SHINGLE, SIMILARITY, FRAGMENTS = 5, 75, 8
#: Shingles that go last in the global order, at most: those most frequent by counts within a task's documents. They
#: set the order only, which changes how many candidates there are, never a result.
FREQUENT = 50_000
_DOCS_COUNTED, _OFTEN = 2000, 4
_BITS = 52
_FRAGMENT_BITS = _BITS - 3
#: Words of 64 parity bits a document has: two for each fragment.
SIGNS = 2 * FRAGMENTS
_SIGN_BITS = _BITS - 4
_LATE = 2**63 - 1


_SIGN_NAMES = [f"w{k}" for k in range(SIGNS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of fewer than 4096 texts, ascending; shingles as 52-bit hashes."""
    w = Words(data, offsets, (0,), lower=True)
    g = grams(w.hash[0], size)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    whole = sequence_hashes(w.hash[0], w.first[short], w.first[short] + w.count[short])
    doc, h = np.concatenate([w.doc[at], short]).astype(np.uint64), np.concatenate([g[at], whole])
    key = np.unique((doc << np.uint64(_BITS)) | (h >> np.uint64(64 - _BITS)))
    return (key >> np.uint64(_BITS)).astype(np.int64), (key & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _sets(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        for a in range(lo, hi, 4000):
            b = min(hi, a + 4000)
            yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set: its size, 128 bits that stand for it, and its parity bits: each shingle flips one of its fragment's."""
    for batch in batches:
        n, s1, s2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
        signs = np.zeros(batch.num_rows * SIGNS, np.uint64)
        for lo, hi, doc, token in _sets(batch.column("text")):
            n[lo:hi] = np.bincount(doc, minlength=hi - lo)
            some = np.flatnonzero(n[lo:hi])
            if len(some):
                at = np.searchsorted(doc, some)
                s1[lo + some] = np.add.reduceat(mixed(token.astype(np.uint64)), at)
                s2[lo + some] = np.add.reduceat(mixed(~token.astype(np.uint64)), at)
                word = (lo + doc) * SIGNS + (token >> _SIGN_BITS)  # ascending, as shingles are
                first = np.flatnonzero(np.diff(word, prepend=-1))
                signs[word[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (token & 63).astype(np.uint64), first)
        columns = [signed(np.ascontiguousarray(x)) for x in (n, s1, s2, *signs.reshape(-1, SIGNS).T)]
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("doc_id"), *columns], ["did", "doc_id", "n", "s1", "s2", *_SIGN_NAMES])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several of some thousand documents hold."""
    held, docs = [], 0

    def counted():
        token, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= _OFTEN
        return pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(n[many].astype(np.int64))], ["token", "n"])

    for batch in batches:
        for lo, hi, _, token in _sets(batch.column("text")):
            held.append(token)
            docs += hi - lo
        if docs >= _DOCS_COUNTED:
            yield counted()
            held, docs = [], 0
    if held:
        yield counted()


def prefix_size(n, similarity: int = SIMILARITY):
    """As many shingles as a document of n can have without one that a similar document must share."""
    return n - -(-similarity * n // 100) + 1


def _prefixes(frequent: np.ndarray, similarity: int):
    """Each text's first shingles in the global order; frequent: the frequent ones, rarest first."""
    by_token = np.argsort(frequent)
    ordered = frequent[by_token]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids = np.asarray(batch.column("did"))
            for lo, hi, doc, token in _sets(batch.column("text")):
                at = np.minimum(np.searchsorted(ordered, token), max(len(ordered) - 1, 0))
                late = ordered[at] == token if len(ordered) else np.zeros(len(token), bool)
                place = np.where(late, by_token[at] + (1 << _BITS), token) if len(ordered) else token
                order = np.lexsort((place, doc))
                n = np.bincount(doc, minlength=hi - lo)
                within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = order[within < prefix_size(n, similarity)[doc]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[first]), pa.array(dids[lo + doc[first]]), *(pa.array(x[first].astype(np.int32)) for x in (n[doc], _unsorted(order, within)))],
                    ["token", "did", "n", "at"],
                )

    return run


def _unsorted(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles of each fragment, empty ones too; v tells texts of one document apart."""
    for batch in batches:
        for lo, hi, doc, token in _sets(batch.column("text")):
            docs = hi - lo
            ends = np.cumsum(np.bincount(doc * FRAGMENTS + (token >> _FRAGMENT_BITS), minlength=docs * FRAGMENTS))
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(token.astype(np.uint64)), dtype=np.uint64)))
            v = sums[offsets[FRAGMENTS::FRAGMENTS]] - sums[offsets[:-1:FRAGMENTS]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("did").slice(lo, docs).take(pa.array(np.repeat(np.arange(docs), FRAGMENTS))),
                    signed(np.repeat(v, FRAGMENTS)),
                    pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), docs)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(token)),
                ],
                ["did", "v", "fragment", "tokens"],
            )


def _verified(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that are similar, by overlaps counted in each fragment and summed per pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("did")).distinct()
    segments = written(texts.join(ends, "did", "left_semi").mapInArrow(_segments, "did long, v long, fragment int, tokens array<long>"))
    of = lambda end: segments.select(F.col("did").alias(end), "fragment", F.col("v").alias(f"v{end}"), F.col("tokens").alias(f"t{end}"))
    met = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))).join(of("a"), ["a", "fragment"]).join(of("b"), ["b", "fragment"])
    partial = met.select("a", "b", "va", "vb", F.size(F.array_intersect("ta", "tb")).alias("common"), (F.size("ta") + F.size("tb")).alias("n"))
    # Repeated rows of a document multiply both sums alike.
    summed = partial.groupBy("a", "b", "va", "vb").agg(F.sum("common").alias("common"), F.sum("n").alias("n"))
    return summed.where((100 + similarity) * F.col("common") >= similarity * F.col("n")).select("a", "b").distinct()


def _allowed(x: str, y: str, similarity: int) -> Column:
    """Whether the fragments' parity bits leave room: bits that differ are at most the shingles that only one side has.

    Sizes and bits are columns n and w0, w1, ... after the prefixes x and y; where they are null, anything is possible.
    """
    differ = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))) for w in _SIGN_NAMES))
    both = F.col(f"{x}n") + F.col(f"{y}n")
    return F.coalesce((100 + similarity) * (both - differ) >= 2 * similarity * both, F.lit(True))


def _named(signs: DataFrame, end: str, name: str) -> DataFrame:
    return signs.select(F.col("did").alias(name), *(F.col(c).alias(f"{end}{c}") for c in ("n", *_SIGN_NAMES)))


def _possible(n1: Column, e1: Column, n2: Column, e2: Column, similarity: int) -> Column:
    """Whether sizes n, and shingles e that any other document holds, leave room for the similarity."""
    most = F.least(e1, e2, n1, n2)
    return 100 * most >= similarity * (n1 + n2 - most)


def similar_groups(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_shingles, component_id and did (doc_id, or a stand-in for null).

    Documents link when 100 * intersection >= similarity * union; component_id is the least doc_id that links reach. A
    null text counts as empty, whose set is empty and links with nothing. A null doc_id stands after all others and
    gets a null component_id unless it links with a document that has one. Rows that share a doc_id are one node.
    Other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    stand_in = F.lit(_LATE) - F.shiftrightunsigned(F.xxhash64("text"), 24)
    base = base.select(F.coalesce("doc_id", stand_in).alias("did"), "doc_id", "text")
    described = written(base.mapInArrow(_described, "did long, doc_id long, n long, s1 long, s2 long, " + ", ".join(f"{w} long" for w in _SIGN_NAMES)))
    sets = written(described.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("did").alias("rep"), F.count("*").alias("copies")))
    texts = base.select("did", "text")
    often = texts.mapInArrow(_often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = [r["token"] for r in often.orderBy(F.col("n").desc(), "token").limit(FREQUENT).collect()]
    frequent = np.array(often[::-1], np.int64)

    distinct = texts.join(sets.select(F.col("rep").alias("did")), "did", "left_semi")
    tokens = distinct.mapInArrow(_prefixes(frequent, similarity), "token long, did long, n int, at int")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    met = written(tokens.join(shared, "token"))
    # Shingles before a shared one that no other prefix holds can't be in an intersection: e is what can.
    turn = F.row_number().over(Window.partitionBy("did").orderBy("at"))
    posts = met.withColumn("e", F.col("n") - F.greatest(F.col("at") - turn + 1, F.lit(0))).where(100 * F.col("e") >= similarity * F.col("n"))
    rank = F.floor(F.col("e") * 1000 / F.col("n")) * (1 << 44) + F.shiftrightunsigned(F.xxhash64("did"), 20)
    posts = written(posts.select("token", "did", "n", "e", rank.alias("rank")))
    leader = posts.groupBy("token").agg(F.max_by("did", "rank").alias("a"), F.max_by("n", "rank").alias("n_a"), F.max_by("e", "rank").alias("e_a"), F.count("*").alias("m")).where("m > 1")
    to_leader = posts.withColumnRenamed("did", "b").join(leader, "token").where("a != b").where(_possible(F.col("n"), F.col("e"), F.col("n_a"), F.col("e_a"), similarity))
    single = F.min("s1") == F.max("s1")  # texts that share a doc_id have no bits in common
    signs = described.where("n > 0").groupBy("did").agg(*(F.when(single, F.min(c)).alias(c) for c in ("n", *_SIGN_NAMES)))
    signs = written(signs.join(sets.select(F.col("rep").alias("did")), "did", "left_semi"))
    bounded = lambda pairs: pairs.join(_named(signs, "x", "a"), "a").join(_named(signs, "y", "b"), "b").where(_allowed("x", "y", similarity)).select("a", "b")

    seen = written(bounded(to_leader.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    links = written(_verified(seen, texts, similarity))
    label = components(links)
    placed = posts.join(label.withColumnRenamed("node", "did"), "did", "left").withColumn("c", F.coalesce("component", "did")).drop("component", "rank")
    split = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    rest = written(placed.join(split, "token"))
    signed_rest = rest.join(_named(signs, "s", "did"), "did").repartition("token")  # both sides of the join read one shuffle
    side = lambda x, end: signed_rest.select("token", F.col("did").alias(end), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "e", "c")), *(F.col(f"s{c}").alias(f"{x}{c}") for c in ("n", *_SIGN_NAMES)))
    apart = (F.col("a") < F.col("b")) & (F.col("x_c") != F.col("y_c")) & _possible(F.col("x_n"), F.col("x_e"), F.col("y_n"), F.col("y_e"), similarity)
    left, right = side("x", "a"), side("y", "b").withColumnRenamed("token", "other")
    met_in = left.join(right, (left["token"] == right["other"]) & apart & _allowed("x", "y", similarity)).groupBy("a", "b", "x_n", "y_n").agg(F.count("*").alias("c"))
    # Past the shorter reach of the two prefixes, which share c, a document has at most its shingles after its prefix.
    after = lambda n: F.ceil(F.col(n) * similarity / 100) - 1
    enough = (100 + similarity) * (F.col("c") + F.greatest(after("x_n"), after("y_n"))) >= similarity * (F.col("x_n") + F.col("y_n"))
    more = written(met_in.where(enough).select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.unionByName(written(_verified(more, texts, similarity)))

    component = components(links)
    named = sets.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    out = described.join(named, ["s1", "s2", "n"], "left").withColumn("component", F.coalesce("component", "did"))
    known = F.when(F.col("component") <= _LATE - (1 << 40), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), known.alias("component_id"), "did", F.col("component").alias("_component"))


def one_of_each_group(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, with their columns, of one document of each group of similar ones: the one of least doc_id.

    Documents without words link with nothing, so all stay. Of repeated rows one stays.
    """
    groups = similar_groups(docs, similarity)
    least = groups.where("did = _component").select("did").distinct()
    columns = docs.columns
    stand_in = F.lit(_LATE) - F.shiftrightunsigned(F.xxhash64(full_text()), 24)
    did, turn = free_names(docs, "_did", "_turn")
    mine = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), stand_in))
    kept = mine.join(least.withColumnRenamed("did", did), did)
    first = F.row_number().over(Window.partitionBy(did).orderBy(F.xxhash64("text")))
    return kept.withColumn(turn, first).where(F.col(turn) == 1).select(*(F.col(f"`{c}`") for c in columns))
