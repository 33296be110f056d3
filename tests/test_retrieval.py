"""Lexical and dense retrieval against brute force; that tasks send on their best rows only."""

import math
import random

import duckdb
import numpy as np
import pytest

from groundspark.operators import dense, lexical
from groundspark.plans import retrieval

WORDS = ["a", "b", "c", "d", "e", "é", "the"]


def bag(words):
    return words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]


def brute_bm25(queries, docs, k):
    n, avg = len(docs), sum(map(len, docs.values())) / max(1, len(docs)) or 1.0
    df = {t: sum(t in w for w in docs.values()) for w in docs.values() for t in w}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    add = lambda w, t: idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg))
    scores = {q: sorted((-round(sum(add(w, t) for t in ts), 6) + 0.0, d) for d, w in docs.items())[:k] for q, ts in queries.items()}
    return sorted((q, r, d, -s + 0.0) for q, found in scores.items() for r, (s, d) in enumerate(found, 1))


def frames(spark, queries, docs, parts=3):
    q = spark.createDataFrame(list(queries.items()), "qid long, terms array<string>")
    return q, spark.createDataFrame(list(docs.items()), "doc_id long, terms array<string>").repartition(parts)


@pytest.mark.parametrize("pairs", [False, True])
def test_bm25_against_brute_force(spark, pairs, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 7)
    rng = random.Random(3)
    docs = {k: rng.choices(WORDS, weights=[9, 5, 4, 3, 2, 1, 40], k=rng.randrange(12)) for k in rng.sample(range(500), 90)}
    queries = {k: rng.choices([*WORDS, "zz"], k=rng.randrange(6)) for k in range(16)}
    queries = {k: bag(v) for k, v in queries.items()} if pairs else queries
    got = lexical.bm25_topk(*frames(spark, queries, docs), 5, pairs=pairs).select("qid", "rank", "doc_id", "score").collect()
    want = brute_bm25(queries, {k: bag(v) for k, v in docs.items()} if pairs else docs, 5)
    assert [r[:3] for r in sorted(map(tuple, got))] == [r[:3] for r in want]
    assert sorted(map(tuple, got)) == [pytest.approx(r, abs=2e-6) for r in want]


def test_a_negative_mean_idf_gives_scores_below_those_without_a_common_term(spark):
    """One document more or less: its terms are in most documents, so that all idfs and their mean are negative."""
    docs, queries = {1: ["a", "b"], 2: ["a", "b"], 3: []}, {1: ["a"], 2: ["zz"]}
    got = sorted(map(tuple, lexical.bm25_topk(*frames(spark, queries, docs), 5).select("qid", "rank", "doc_id", "score").collect()))
    assert got == [pytest.approx(r, abs=2e-6) for r in brute_bm25(queries, docs, 5)] and got[0][2:] == (3, 0.0) and got[1][3] < 0
    assert lexical.bm25_topk(*frames(spark, queries, {1: []}), 5).count() == 2
    none = lambda x: frames(spark, queries, docs)[x].limit(0)
    assert lexical.bm25_topk(none(0), none(1), 5).count() == 0 and lexical.bm25_topk(frames(spark, queries, docs)[0], none(1), 5).count() == 0


def test_documents_are_searched_where_they_are_read(spark, monkeypatch):
    """Each search sends on k rows a query at most, though all documents share a term with all queries."""
    monkeypatch.setattr(lexical, "POSTINGS", 300)
    docs, queries = {k: ["the", "x" * (k % 5)] for k in range(1000)}, {1: ["the"], 2: ["the", "x"]}
    q, d = frames(spark, queries, docs)
    for block, vocabulary, index in lexical.indexed_blocks(q, d):
        plans = [(qid, np.array([vocabulary.index(t) for t in terms]), np.ones(len(terms))) for qid, terms in block]
        sent = lexical.best_documents(index, plans, lambda tf, n: tf, 3, q.schema["qid"], True)
        assert 6 <= sent.count() <= 6 * (1000 // 100 + 4)
    got = lexical.shared_topk(q, d, 3).collect()
    assert sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in got) == [(1, 1, 0, 1), (1, 2, 1, 1), (1, 3, 2, 1), (2, 1, 1, 2), (2, 2, 6, 2), (2, 3, 11, 2)]


def test_terms_are_counted_in_documents(spark, monkeypatch):
    docs = {1: ["a", "b", "a", "b"], 2: ["b", "a"], 3: ["a"], 4: [], 5: ["a", "b"]}
    _, d = frames(spark, {1: []}, docs, 1)
    counts = lambda pairs: sorted(r["df"] for r in lexical.document_frequencies(d, pairs).collect() for _ in range(r["terms"]))
    assert counts(False) == [3, 4] and counts(True) == [2, 2, 3, 4]  # a_b and b_a in two each
    monkeypatch.setattr(lexical, "TERMS", 5)
    many = {k: [f"w{(k * k + j) % 97}" for j in range(k % 9)] for k in range(400)}
    _, d = frames(spark, {1: []}, many)
    want = sorted(sum(t in w for w in map(bag, many.values())) for t in {t for w in many.values() for t in bag(w)})
    assert counts(True) == want
    a = np.array([5, 5, 5, 7], np.uint64)  # terms that share 64 bits and differ in the others stay apart
    assert [x.tolist() for x in lexical._summed(a, np.array([1, 2, 1, 1], np.uint16), np.array([1, 1, 1, 1]))] == [[5, 5, 7], [1, 2, 1], [2, 1, 1]]


def test_lexical_queries_against_their_sql(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices([*WORDS, "x1", "12", "É!"], k=n)) or None
    tables = {
        "documents": ([(k, text(rng.randrange(40)), "s") for k in range(80)], "doc_id long, text string, source string"),
        "benchmark": ([(k, text(rng.randrange(1, 9))) for k in range(9)], "item_id long, text string"),
        "labels": ([(k, k % 2, k % 3 % 2) for k in range(0, 80, 3)], "doc_id long, quality int, toxic int"),
        "embeddings": ([(k, [float(np.float32(rng.gauss(0, 1))) for _ in range(5)]) for k in range(70)], "vec_id long, embedding array<float>"),
    }
    con = duckdb.connect()
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("bm25_topk", "rrf_words", "rerank_labels", "rrf_hybrid", "hybrid_rerank", "dense_topk"):
        got = retrieval.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(retrieval.SQL[name]).fetchall())), name


def test_dense_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.0, 0.5, 0.0, 1.0]) for _ in range(3)]
    vectors = [(k, vector()) for k in rng.sample(range(9000), 1500)]
    queries = [(k, vector()) for k in range(9)]
    v, q = spark.createDataFrame([*vectors, (9001, None)], "vec_id long, v array<float>").repartition(2), spark.createDataFrame(queries, "qid long, q array<float>")
    got = sorted((r["qid"], r["rank"], r["vec_id"], r["score"]) for r in dense.dense_topk(q, v, 7).collect())
    want = {k: sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)), 6), i) for i, y in vectors)[:7] for k, x in queries}
    assert got == sorted((k, r, i, -s) for k, found in want.items() for r, (s, i) in enumerate(found, 1))
    assert dense.dense_best(q, v, 7).count() <= 9 * 7 * 4 * 2  # rows of a task and a block, not of all pairs
    few = spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("y", None), ("z", [1.0, None, 3.0])], "vec_id string, v array<float>")
    assert [(r["vec_id"], r["score"]) for r in dense.dense_topk(q.limit(1), few, 5).orderBy("rank").collect()][1:] == [("y", None), ("z", None)]
    assert dense.dense_topk(q.limit(0), v, 7).count() == 0 and dense.dense_topk(q, v.limit(0), 7).count() == 0
