"""Ranked lexical search: term at a time, rarest first, with accumulators limited by the bounds of the terms that are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import full_text, prepare, text_bytes, written

K = 10
#: Items searched for in one pass over the documents, and postings that a task turns into an index of its own at a time.
BLOCK, POSTINGS = 20_000, 4_000_000
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(column) -> tuple[pa.Array, np.ndarray]:
    """All terms of an Arrow string column without nulls, in order and lower-cased (A-Z), and where each text's begin."""
    data, offsets = text_bytes(column)
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1]))
    kept = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    at = np.concatenate((kept[start], [kept[-1]]))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOW[data[inside]])])
    return found, np.searchsorted(start, offsets)


def item_terms(items: DataFrame) -> dict[int, list[bytes]]:
    """The distinct terms of each item (item_id, text); rows of one item_id are one item, rows without a text add nothing."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), full_text().alias("text")).toArrow().combine_chunks()
    out: dict[int, set[bytes]] = {}
    if rows.num_rows:
        found, first = terms(rows.column("text").chunk(0))
        words = found.to_pylist()
        for k, item in enumerate(rows.column("item_id").to_pylist()):
            out.setdefault(item, set()).update(words[first[k] : first[k + 1]])
    return {k: sorted(v) for k, v in sorted(out.items())}


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs) written to the shared folder: each text's number of terms, and those of the vocabulary that it holds.

    Terms are matched as bytes by Arrow's lookup, so no hash stands for a term.
    """
    sought = pa.array(vocabulary, pa.large_binary())

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = terms(batch.column("text"))
            ids = pc.fill_null(pc.index_in(found, value_set=sought), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            key, tf = np.unique((doc * len(sought) + ids)[ids >= 0], return_counts=True)
            at = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * len(sought)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (key % max(1, len(sought)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    return written(rows.mapInArrow(indexed, "doc_id long, n long, ids array<int>, tfs array<int>"))


class Shard:
    """An inverted index of some documents: postings by term, with what each adds to a score before its weight."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, terms_total: int, vocabulary: int):
        self.doc = doc
        m = 10 + 90 * n * total // max(1, terms_total)
        row = np.repeat(np.arange(len(doc)), np.diff(at))
        order = np.argsort(term, kind="stable")
        tf = tf[order].astype(np.int64)
        self.row = row[order]
        self.base = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.row])
        self.at = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        some = np.flatnonzero(np.diff(self.at))
        self.most[some] = np.maximum.reduceat(self.base, self.at[some]) if len(some) else 0

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best and their ties; ids are rarest first, floor is a k-th score known from elsewhere.

        New accumulators are made until the terms left can't lift a new document to the k-th partial score; those that
        exist are updated to the end, so their scores are exact.
        """
        score, open_ = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc), bool)
        left = np.concatenate((np.cumsum((weights * self.most[ids])[::-1])[::-1], [0]))
        growing = True
        for i, (t, w) in enumerate(zip(ids.tolist(), weights.tolist(), strict=True)):
            if growing and left[i] <= left[0] - left[i] or floor > left[i]:  # no partial score is above what the terms so far can give
                growing = growing and left[i] >= max(floor, _kth(score[open_], k))
            rows, base = self.row[self.at[t] : self.at[t + 1]], self.base[self.at[t] : self.at[t + 1]]
            if not growing:
                old = open_[rows]
                rows, base = rows[old], base[old]
            score[rows] += w * base
            open_[rows] = True
        found = np.flatnonzero(open_ & (score > 0))
        found = found[score[found] >= max(floor, _kth(score[found], k))]
        return self.doc[found], score[found]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest; 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _best(doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, -score))[:k]
    return doc[order], score[order]


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text) with a score above 0.

    Documents are dealt to tasks as they are read: each task indexes its own, searches all items of a block with the
    k-th scores of what it saw before as floors, and sends on k rows an item at most. Null texts have no terms; documents
    with a null doc_id count in the statistics but can't be returned; repeated rows are documents of their own; equal
    scores rank by doc_id; items without terms, a null item_id and empty tables give no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    wanted = list(item_terms(items).items())
    blocks = [_block(docs, dict(wanted[lo : lo + BLOCK]), k) for lo in range(0, max(1, len(wanted)), BLOCK)]
    found = blocks[0]
    for block in blocks[1:]:
        found = found.unionByName(block)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, wanted: dict[int, list[bytes]], k: int) -> DataFrame:
    vocabulary = sorted({t for ts in wanted.values() for t in ts})
    place = {t: i for i, t in enumerate(vocabulary)}
    index = forward_index(docs, vocabulary)
    size = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    total, terms_total = size["docs"], size["terms"] or 0
    df = index.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(vocabulary), np.int64)
    for r in df.select("t", weight.alias("w")).collect():  # a number for each term of the block's items
        weights[r["t"]] = r["w"]
    plans = []
    for item, ts in wanted.items():
        ids = np.array([place[t] for t in ts], np.int64)
        ids = ids[np.argsort(-weights[ids], kind="stable")]
        plans.append((item, ids[weights[ids] > 0]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item, _ in plans}

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = {c: table.column(c).chunk(0) for c in table.column_names}
            at = columns["ids"].offsets.to_numpy().astype(np.int64)
            flat = lambda c: columns[c].flatten().to_numpy()
            shard = Shard(columns["doc_id"].to_numpy(), columns["n"].to_numpy(), at - at[0], flat("ids"), flat("tfs"), total, terms_total, len(vocabulary))
            for item, ids in plans:
                doc, score = best[item]
                new = shard.search(ids, weights[ids], k, _kth(score, k))
                best[item] = _best(np.concatenate((doc, new[0])), np.concatenate((score, new[1])), k)

        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("ids").flatten()) + batch.num_rows
            if postings >= POSTINGS:
                search(held)
                held, postings = [], 0
        if held:
            search(held)
        items = np.repeat([i for i, _ in plans], [len(best[i][0]) for i, _ in plans]).astype(np.int64)
        flat = lambda j: np.concatenate([np.zeros(0, np.int64), *(best[i][j] for i, _ in plans)])
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(flat(0)), pa.array(flat(1))], ["item_id", "doc_id", "score"])

    return index.where("doc_id is not null").mapInArrow(searched, "item_id long, doc_id long, score long")


_T = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_T} AS ts FROM documents),
s AS (SELECT count_if(len(ts) > 0)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n),
q AS (SELECT DISTINCT item_id, unnest({_T}) AS term FROM benchmark WHERE item_id IS NOT NULL),
m AS (SELECT id, doc_id, 10 + (90 * len(ts) * n) // l AS m FROM d, s WHERE len(ts) > 0 AND doc_id IS NOT NULL),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (id) GROUP BY item_id, id, doc_id)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0) WHERE rank <= 10"""
