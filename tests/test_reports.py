"""Evaluation of several arms, answer and calibration reports, manifests, showcases: contents, order and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from groundspark.operators import replay, reports, verification
from groundspark.sources.reports import answers_file, read_report, write_report


def same(spark, tables, folder):
    write_report(tables, folder)
    back = read_report(spark, folder, *tables)
    for name, table in tables.items():
        assert back[name].schema.simpleString() == table.schema.simpleString()
        as_json = lambda df: sorted(df.toJSON().collect())
        assert as_json(back[name]) == as_json(table)
    return back


def test_arms(spark, tmp_path):
    questions = spark.createDataFrame([("q1", "factoid_1hop", True), ("q2", "multihop", True), ("q3", "unanswerable_nearmiss", False), ("q4", "multihop", True)], "qid string, type string, answerable boolean")
    spans = spark.createDataFrame([("q1", 0, "d", 0, 10), ("q2", 0, "d", 0, 10), ("q2", 1, "e", 0, 10), ("q3", 0, "d", 0, 1)], "qid string, span_ix int, doc_id string, s int, e int")
    rows = [("bm25", q, r, f"c{r}", doc, s, s + 10) for q in ("q1", "q2") for r, (doc, s) in enumerate([("d", 0), ("x", 0), ("e", 1)], 1)] + [("dense", "q1", 1, "c9", "d", 5, 10), ("rerank", "q1", 1, "c1", "d", 0, 10)]
    ranked = spark.createDataFrame(rows, "arm string, qid string, rank int, chunk_id string, doc_id string, s int, e int")
    missing = spark.createDataFrame([("rerank", "no record of rerank")], "arm string, reason string")
    tables = reports.arm_results(spans, ranked, questions, ["bm25", "dense", "rerank", "hybrid"], ks=(1, 3), missing=missing)
    assert {tuple(r) for r in tables["skipped"].collect()} == {("rerank", "no record of rerank"), ("hybrid", "no rows")}
    got = {(r["arm"], r["type"], r["k"]): (r["n"], r["recall_strict"], r["recall_any"], r["mean_cov"], r["mrr"]) for r in tables["arms"].collect()}
    assert got["bm25", None, 1] == (3, 0.3333, 0.6667, 0.5, 0.4444) and got["bm25", None, 3] == (3, 0.6667, 0.6667, 0.65, 0.4444)
    assert got["bm25", "multihop", 3] == (2, 0.5, 0.5, 0.475, 0.1667) and got["dense", "factoid_1hop", 1] == (1, 0.0, 0.0, 0.5, 0.0)
    assert ("bm25", "unanswerable_nearmiss", 1) not in got and len(got) == 12
    q2 = tables["questions"].where("arm = 'bm25' and qid = 'q2'").first()
    assert (q2["r_star"], q2["mrr"], q2["ranked_chunk_ids"]) == (3, 0.333333, ["c1", "c2", "c3"])
    assert [(s["doc_id"], s["r_star"], s["cov"]) for s in q2["spans"]] == [("d", 1, {"1": 1.0, "3": 1.0}), ("e", 3, {"1": 0.0, "3": 0.9})]
    same(spark, tables, str(tmp_path / "retrieval"))
    first = json.loads(next((tmp_path / "retrieval" / "arms").glob("part-00000*")).read_text().split("\n")[0])
    assert (first["arm"], first["k"], first["type"]) == ("bm25", 1, None)  # nulls are written, the order is fixed


def test_answers_calibration_and_showcase(spark, tmp_path):
    gen, judge = replay.Call("generate", "p", "m"), replay.Call("judge", "p", "m")
    context = [(1, "c1", "Điều 1 A"), (2, "c2", "Điều 2 A")]
    asked = spark.createDataFrame([("a", "qa", context, 1.0), ("b", "qb", context, 0.0), ("c", "qc", context, 1.0)], "qid string, question string, context array<struct<rank:int,chunk_id:string,label:string>>, top_score double")
    ids = F.array(F.lit("c1"), F.lit("c2"))
    cite = F.array(F.array(F.lit(2).cast("bigint")))
    keys = asked.select(
        "qid", F.sha2(gen.payload(question=F.col("question"), context=ids, attempt=F.lit(1), feedback=F.lit("")), 256).alias("g"),
        F.sha2(judge.payload(question=F.col("question"), claims=F.array(F.lit("Có.")), citations=cite, context=ids), 256).alias("j"),
    ).collect()
    said = {"a": '{"claims": [{"text": "Có.", "citations": [2]}]}', "b": '{"claims": [{"text": "Có.", "citations": [2]}]}', "c": '{"abstain": true, "reason": "r"}'}
    records = [(k["g"], said[k["qid"]]) for k in keys] + [(k["j"], '{"verdicts": [{"claim_id": 1, "supported": true}]}') for k in keys]
    made = replay.attempts(asked, spark.createDataFrame(records, "digest string, response string"), gen, judge)
    questions = spark.createDataFrame([("a", "qa", "factoid_1hop", True), ("b", "qb", "unanswerable_nearmiss", False), ("c", "qc", "multihop", True)], "qid string, question string, type string, answerable boolean")
    tables = reports.answer_report(questions, replay.answered(asked, made, 0.5, 1.0), made, "hybrid_rerank", 0.5, 1.0)
    summary = tables["summary"].first()
    assert summary["abstain"].asDict() == {"tp": 1, "fp": 1, "fn": 0, "tn": 1, "precision": 0.5, "recall": 1.0, "f1": 0.6667}
    assert summary["faithfulness"].asDict() == {"n_answered": 1, "n_abstained": 2, "ratio_first": 1.0, "ratio_final": 1.0, "n_retry": 0, "n_check_a_fail": 0, "at_retrieve": 1, "at_model": 1, "at_check_a": 0, "at_check_b": 0}
    back = same(spark, tables, str(tmp_path / "answers"))["questions"]
    rows = {r["qid"]: r for r in back.collect()}
    assert rows["a"]["answer"] == "Có. [2]" and rows["a"]["citations"] == ["[2] Điều 2 A"] and len(rows["a"]["attempts"]) == 1
    assert rows["b"]["stage"] == "retrieve" and rows["b"]["attempts"] == [] and rows["c"]["stage"] == "model"
    text = reports.showcase(back, "hybrid_rerank", 0.5, 1.0).first()["text"]
    assert text.index("## 1. a — `factoid_1hop`") < text.index("## 2. c — `multihop`") < text.index("## 3. b — `unanswerable_nearmiss`")
    assert "- `[2] Điều 2 A`" in text and "support before checks: 1.000" in text and "**declined** at `model`" in text

    tries = spark.createDataFrame([("a", 1, 1.0, False, True, 0.5, False), ("b", 1, 0.0, False, True, 1.0, True)], "qid string, attempt int, top_score double, abstained boolean, check_a boolean, ratio double, should_abstain boolean")
    grid = spark.createDataFrame([(r, g) for r in (0.0, 0.5) for g in (0.5, 1.0)], "tau_r double, tau_g double")
    outcomes = verification.answer_outcomes(tries, grid).join(tries.select("qid", "should_abstain"), "qid")
    found = reports.calibration_report(outcomes)
    best = found["best"].first()
    assert (best["tau_r"], best["tau_g"], best["plateau_size"], best["abstain"]["f1"]) == (0.5, 0.5, 1, 1.0) and found["grid"].count() == 4
    same(spark, found, str(tmp_path / "calibration"))


def test_an_answers_file(spark, tmp_path):
    attempt = {"attempt": 1, "draft": {"abstain": False, "reason": "", "claims": [{"text": "t", "citations": [1]}]}, "check_a": {"ok": True, "problems": []}, "check_b": None}
    item = {"qid": "q1", "type": "multihop", "answerable": True, "question": "?", "answer": "t [1]", "citations": ["[1] x"], "abstained": False, "abstain_stage": None, "retrieval_score": 1.0, "support_ratio_first": None, "support_ratio_final": 0.5, "attempts": [attempt]}
    path = tmp_path / "answers.json"
    path.write_text(json.dumps({"arm": "bm25", "tau_retrieve": 0.0, "tau_ground": 1.0, "questions": [item, {**item, "qid": "q2"}]}, indent=2))
    rows = answers_file(spark, str(path)).orderBy("qid").collect()
    assert [(r["arm"], r["qid"], r["n_attempts"], r["ratio_final"], r["stage"]) for r in rows] == [("bm25", "q1", 1, 0.5, None), ("bm25", "q2", 1, 0.5, None)]
    assert rows[0]["attempts"][0]["draft"]["claims"][0]["text"] == "t"
    assert "## 1. q1" in reports.showcase(answers_file(spark, str(path)), "bm25", 0.0, 1.0).first()["text"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        answers_file(spark, str(tmp_path / "none.json"))


def test_manifest_and_chunk_report(spark, tmp_path):
    docs = spark.createDataFrame([("d", "Luật", "law", "active", "2020", None), ("e", "Luật E", "law", "expired", "2019", "2021")], "doc_id string, title string, doc_type string, status string, effective_from string, effective_to string")
    rows = [(f"{d}#a{k}#c0#p0", d, k, "T", "C", None, "0", 0, 10 * k, 10 * k + 9, "text", n, False) for d, k, n in (("d", 1, 10), ("d", 2, 10), ("e", 1, 100))]
    kind = "chunk_id string, doc_id string, article_no int, title string, chapter string, section string, clause_range string, part int, s int, e int, text string, n_tokens int, is_lead_in boolean"
    chunks = spark.createDataFrame(rows, kind)
    tables = reports.chunk_manifest(chunks, docs, {"most": 600, "least": 120})
    assert tables["settings"].first().asDict() == {"most": 600, "least": 120, "n_chunks": 3}
    back = same(spark, tables, str(tmp_path / "index"))
    assert [(r["chunk_id"], r["citation_label"], r["effective_to"]) for r in back["chunks"].orderBy("chunk_id").collect()][2] == ("e#a1#c0#p0", "Điều 1 Luật E", "2021")
    with pytest.raises(Exception, match="repeated chunk_id d#a1"):
        reports.chunk_manifest(chunks.unionByName(chunks.limit(1)), docs, {})["chunks"].collect()
    row = reports.chunk_report(docs, chunks.select("doc_id", "article_no").distinct(), chunks).first().asDict()
    assert row == {"n_documents": 2, "n_articles": 3, "n_chunks": 3, "least": 10, "p25": 10.0, "median": 10.0, "p75": 55.0, "most": 100, "n_active": 2, "active_share": 66.7, "n_expired": 1, "expired_share": 33.3, "skewed": True}
    empty = reports.chunk_report(docs.limit(0), chunks.limit(0), chunks.limit(0)).first()
    assert (empty["n_chunks"], empty["median"], empty["active_share"], empty["skewed"]) == (0, 0.0, 0.0, False)
