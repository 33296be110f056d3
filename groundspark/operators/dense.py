"""Exact dense retrieval: each query vector against all vectors, as products of matrices; each task sends on its best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from groundspark.operators.ranking import DIGITS, rank_by_score

#: Queries that go to the tasks at once; larger sets go through in blocks.
QUERY_BLOCK = 8192
#: Vectors that meet a block at a time, which bounds what a task holds, and products of a task, about.
TILE, TASK = 512, 400_000_000


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix of doubles, and which rows have no vector of that width: nulls, nulls within, other lengths."""
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max([0, *n.tolist()]) if width is None else width
    flat = column.flatten()
    if not flat.null_count and (n == width).all():
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(n), width), np.zeros(len(n), bool)
    out, bad = np.zeros((len(n), width)), np.ones(len(n), bool)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i], bad[i] = v, False
    return out, bad


class _Best:
    """The k best vectors of each query so far: rounded score, then id; -inf stands for a pair without a score, which comes last."""

    def __init__(self, queries: np.ndarray, bad: np.ndarray, k: int, ids: pa.DataType):
        self.queries, self.bad, self.k, self.odd = queries.T.copy(), bad, k, not np.isfinite(queries).all()
        self.floor = np.full(len(queries), -np.inf)
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), pa.array([], ids)

    def add(self, ids: pa.Array, vectors: np.ndarray, bad: np.ndarray) -> None:
        scores = vectors @ self.queries
        if self.odd or not np.isfinite(vectors).all():
            scores[np.isnan(scores)] = np.inf  # as Spark and SQL sort it
        scores[bad] = -np.inf
        scores[:, self.bad] = -np.inf
        if len(scores) > self.k:
            new = np.flatnonzero(np.isneginf(self.floor))
            if len(new):
                self.floor[new] = np.partition(scores[:, new], len(scores) - self.k, axis=0)[len(scores) - self.k] - 10.0**-DIGITS
        row, q = np.nonzero(scores >= self.floor)
        if len(row):
            self.q, self.id = np.concatenate((self.q, q)), pa.concat_arrays([self.id, ids.take(pa.array(row))])
            self.score = np.concatenate((self.score, np.floor(scores[row, q] * 10.0**DIGITS + 0.5) / 10.0**DIGITS))
            self.cut()

    def cut(self) -> None:
        place = np.empty(len(self.id), np.int64)
        place[pc.array_sort_indices(self.id, null_placement="at_start").to_numpy()] = np.arange(len(self.id))
        order = np.lexsort((place, -self.score, self.q))
        q = self.q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[nth < self.k]
        full = order[nth == self.k - 1]
        self.q, self.score, self.id, last = self.q[kept], self.score[kept], self.id.take(pa.array(kept)), (self.q[full], self.score[full])
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[1] - 10.0**-DIGITS)  # what rounds to the k-th score at least is above


def dense_best(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score): rows with the k best vectors (vec_id, v) of each query (qid, q) among those of a task, in blocks of queries.

    Scores are rounded inner products. No row is made for any other pair; vectors are dealt to tasks by the number of pairs.
    """
    n, m = queries.count(), vectors.count()
    blocks, tasks = max(1, -(-n // QUERY_BLOCK)), max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n * m // TASK))
    numbered = queries.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("_block"))
    dealt, out = vectors.select("vec_id", "v").repartition(tasks), None
    shape = T.StructType([queries.schema["qid"], vectors.schema["vec_id"], T.StructField("score", T.DoubleType())])
    to_arrow = to_arrow_type(vectors.schema["vec_id"].dataType)
    for b in range(blocks):
        block = numbered.where(F.col("_block") == b).select("qid", "q").toArrow().combine_chunks()  # stated queries, some MB
        qids = block.column("qid").combine_chunks()
        held, bad = _matrix(block.column("q").combine_chunks())
        scored = dealt.mapInArrow(_searched(qids, held, bad, k, to_arrow, shape.names), shape)
        out = scored if out is None else out.unionByName(scored)
    return out


def _searched(qids: pa.Array, queries: np.ndarray, bad: np.ndarray, k: int, ids: pa.DataType, names: list[str]):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, bad, k, ids)
        for batch in batches:
            for lo in range(0, batch.num_rows if len(qids) else 0, TILE):
                part = batch.slice(lo, TILE)
                best.add(part.column("vec_id"), *_matrix(part.column("v"), queries.shape[1]))
        score = pa.array(best.score, mask=np.isneginf(best.score))
        score = pc.if_else(pc.is_inf(score), pa.scalar(np.nan), score) if np.isposinf(best.score).any() else score
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(best.q)), best.id, score], names)

    return searched


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query by inner product, rounded, then vec_id."""
    return rank_by_score(dense_best(queries, vectors, k), "qid", "score", "vec_id", k)
