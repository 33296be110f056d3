"""Operators on small fixtures: exact values, edge cases, metamorphic properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from groundspark.functions import answers
from groundspark.functions import json as js
from groundspark.functions import text as tx
from groundspark.operators import chunking, gold, intervals, ranking, structure, verification
from groundspark.operators.lexical import bm25_topk
from groundspark.sources import corpus

BODY = "\nChương I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\nVăn bản này quy định.\nĐiều 2. Giải thích\nLời dẫn.\n1. Một là theo Điều 5.\n2. Hai là.\n4. Không phải khoản.\n3. Ba là.\n"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_tokens_and_bag(spark):
    words = tx.tokens(F.col("t"))
    assert one(spark, "Điều 12, khoản_b!", words) == ["điều", "12", "khoản", "b"]
    assert one(spark, "a b a", tx.bag(words)) == ["a", "b", "a", "a_b", "b_a"]
    assert one(spark, "", tx.bag(words)) == []
    assert one(spark, "x" * 7, tx.token_estimate(F.col("t"))) == 2
    assert one(spark, "", tx.token_estimate(F.col("t"))) == 1


def test_frontmatter(spark):
    good = "---\r\ndoc_id: d1\ntitle: 'T: x'\n# note\ndoc_type: law\nissued_date: 2020-01-01\neffective_from: 2020-02-01\neffective_to: null\nstatus: active\nstatus: expired\n---\nBody\n"
    rows = corpus.parse_frontmatter(spark.createDataFrame([("a", good), ("b", "no front"), ("c", "---\nbad line\n---\n")], "source string, text string"))
    found = {r["source"]: r for r in rows.collect()}
    assert found["a"]["problem"] is None and found["a"]["meta"]["title"] == "T: x" and found["a"]["meta"]["status"] == "expired"
    assert found["a"]["meta"]["effective_to"] is None and found["a"]["body"] == "Body\n"
    assert found["b"]["problem"] == "no frontmatter" and found["c"]["problem"].startswith("bad line")


def test_structure_and_chunks(spark):
    bodies = spark.createDataFrame([("d", BODY)], "doc_id string, body string")
    lines = structure.lines(bodies)
    for r in lines.collect():
        assert BODY[r["s"] : r["e"]] == r["line"].rstrip(" ")
    found = structure.articles(lines)
    rows = found.orderBy("article_seq").collect()
    assert [(r["article_no"], r["title"], r["chapter"]) for r in rows] == [(1, "Phạm vi", "Chương I. QUY ĐỊNH CHUNG"), (2, "Giải thích", "Chương I. QUY ĐỊNH CHUNG")]
    clauses = structure.clauses(lines, found)
    got = [(r["article_no"], r["clause_no"], BODY[r["s"] : r["e"]]) for r in clauses.orderBy("article_seq", "s").collect()]
    assert got[0] == (1, 0, "Văn bản này quy định.") and got[1] == (2, 0, "Lời dẫn.")
    assert [g[1] for g in got] == [0, 0, 1, 2, 3] and "4. Không" in got[3][2]
    chunked = chunking.chunks(clauses, bodies, found)
    for r in chunked.collect():
        assert BODY[r["s"] : r["e"]] == r["text"]


def test_headers_go_to_the_first_chunk_of_an_article(spark):
    body = "Chương I\n\nCHUNG\nĐiều 1. Một\nLời dẫn\n1. Là\n\nMục 1\nĐiều 2. Hai\nChương II\nMục 1\nRIÊNG\nĐiều 3. Ba\nBa là\nĐiều 4. Bốn"
    bodies = spark.createDataFrame([("d", body)], "doc_id string, body string")
    lines = structure.lines(bodies)
    found = structure.articles(lines)
    rows = chunking.chunks(structure.clauses(lines, found), bodies, found).orderBy("s").collect()
    got = [(r["chunk_id"], r["chapter"], r["section"], r["text"], r["is_lead_in"]) for r in rows]
    assert got == [
        ("d#a1#c0#p0", "Chương I. CHUNG", None, "Chương I\n\nCHUNG\nĐiều 1. Một\nLời dẫn", True),
        ("d#a1#c1#p0", "Chương I. CHUNG", None, "1. Là", False),
        ("d#a2#c0#p0", "Chương I. CHUNG", "Mục 1", "Mục 1\nĐiều 2. Hai", False),
        ("d#a3#c0#p0", "Chương II", "Mục 1. RIÊNG", "Chương II\nMục 1\nRIÊNG\nĐiều 3. Ba\nBa là", False),
        ("d#a4#c0#p0", "Chương II", "Mục 1. RIÊNG", "Điều 4. Bốn", False),
    ]
    bodies_left = chunking.coverage_holes(spark.createDataFrame([(r["doc_id"], r["s"], r["e"]) for r in rows], "doc_id string, s int, e int"), bodies)
    assert bodies_left.count() == 0


def test_packing_never_splits_and_merges():
    text = " ".join(f"Câu số {i} dài thêm một chút nữa." for i in range(200))
    parts = chunking.overlapping_parts(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:], strict=False):
        assert a < c < b < d and round((b - c) / 3.5) >= 90
    assert chunking.sentences("Theo TP. Hà Nội. Hết") == [(0, 17), (17, 20)]


def test_sentences_and_parts_in_the_jvm_are_those_of_plain_python(spark):
    rng = random.Random(9)
    pieces = ["Câu một. ", "TP. ", "Điều 5. ", "A. ", "hết! ", '"Ừ?" ', "v.v. ", "3.5 ", "...\n", "từ ", "dài " * 30, ". ", "x.y ", "ông B.\u00a0", "² . ", "Nđ. ", "!?)] ", "cuối"]
    texts = ["".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 20, 60]))) for _ in range(300)] + ["", None, "một" * 3000, "Câu. " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for most, share in ((600, 0.15), (20, 0.15), (40, 0.5)):
        got = chunking.with_parts(chunking.with_sentences(rows, "t", "sentences"), "t", "parts", most, share).orderBy("k").collect()
        for r, t in zip(got, texts, strict=True):
            assert [tuple(x) for x in r["sentences"] or []] == chunking.sentences(t or ""), t
            assert [tuple(x) for x in r["parts"]] == chunking.overlapping_parts(t or "", most, share), (most, t)


def test_interval_union_against_sets(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 40), rng.randint(0, 40)) for g in range(20) for _ in range(6)]
    got = intervals.interval_union(spark.createDataFrame(rows, "g int, s int, e int"), ["g"]).collect()
    for g in range(20):
        points = {p for k, s, e in rows if k == g for p in range(s, e)}
        own = sorted((r["s"], r["e"]) for r in got if r["g"] == g)
        assert {p for s, e in own for p in range(s, e)} == points
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))


def test_coverage_does_not_change_when_a_chunk_is_split(spark):
    spans = spark.createDataFrame([("q", 0, "d", 10, 30)], "qid string, span_ix int, doc_id string, s int, e int")
    whole = spark.createDataFrame([("q", 1, "d", 0, 20), ("q", 2, "x", 0, 99)], "qid string, rank int, doc_id string, s int, e int")
    cut = spark.createDataFrame([("q", 1, "d", 0, 12), ("q", 1, "d", 12, 20), ("q", 2, "x", 0, 99)], "qid string, rank int, doc_id string, s int, e int")
    a, b = (intervals.coverage(spans, r, 3).orderBy("k").collect() for r in (whole, cut))
    assert [r["cov"] for r in a] == [r["cov"] for r in b] == [0.5, 0.5, 0.5]


def test_bm25_against_plain_python(spark):
    docs = {1: "a b a c", 2: "b c d", 3: "a", 4: "e e f", 5: ""}
    queries = {1: "a c a", 2: "zz"}
    df = spark.createDataFrame([(k, v.split()) for k, v in docs.items()], "doc_id long, terms array<string>")
    q = spark.createDataFrame([(k, v.split()) for k, v in queries.items()], "qid long, terms array<string>")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in bm25_topk(q, df, 5).collect()}
    words = {k: v.split() for k, v in docs.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df_ = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df_.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    for k, w in words.items():
        want = sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in queries[1].split())
        assert got[1, k] == pytest.approx(want, abs=1e-6)
        assert got[2, k] == 0


def test_fusion_ignores_the_scale_of_scores_and_rerank_keeps_ties(spark):
    rows = [("q", 1, 3.0), ("q", 2, 2.0), ("q", 3, 2.0)]
    make = lambda f: ranking.rank_by_score(spark.createDataFrame([(q, i, s * f) for q, i, s in rows], "q string, i int, s double"), "q", "s", "i")
    fused = [ranking.fuse({"a": make(f), "b": make(1).where("i != 3")}, "q", "i").orderBy("rank") for f in (1, 1000)]
    assert fused[0].collect() == fused[1].collect()
    scores = spark.createDataFrame([("q", 3, 3)], "q string, i int, score int")
    assert [r["i"] for r in ranking.rerank(fused[0], scores, "q", "i").orderBy("rank").collect()] == [3, 1, 2]


def test_json_answers(spark):
    assert one(spark, 'x ```json\n{"a": 1}\n``` y', js.json_body(F.col("t"))) == '{"a": 1}'
    raw = '{"scores": [{"id": 1, "score": 9}, {"id": "2", "score": 1}, {"id": 7, "score": 1}, {"id": 2, "score": 0}, {"id": 3}]}'
    assert one(spark, raw, js.rerank_scores(F.col("t"), F.lit(3))) == {1: 3, 2: 0}
    assert one(spark, '[{"id": 1, "score": 2}]', js.rerank_scores(F.col("t"), F.lit(3))) == {1: 2}
    assert one(spark, '{"scores": [{"id": 1', js.rerank_scores(F.col("t"), F.lit(3))) is None
    assert one(spark, "é", js.canonical(b=F.col("t"), a=F.lit(None).cast("int"))) == '{"a":null,"b":"é"}'


def test_answers_are_read_as_python_reads_them(spark):
    """Numbers, booleans and texts stay apart; what is no list or no object is a broken answer."""
    assert one(spark, "```json\n```{x}", js.json_body(F.col("t"))) == "" and one(spark, "so {a} b", js.json_body(F.col("t"))) == "{a}"
    raw = '{"claims": [{"text": " a ", "citations": [true, 2.7, "3", "x", "2.7", null, [1], -1]}, {"text": 5, "citations": "1"}, {"text": null}, "no", {"citations": [1]}]}'
    assert [(c["text"], c["citations"]) for c in one(spark, raw, answers.draft(F.col("t")))["claims"]] == [("a", [1, 2, 3, -1]), ("5", []), ("None", [])]
    for value, truth in (("false", False), ('"false"', True), ("0", False), ('""', False), ("null", False), ("[]", False), ("{}", False), ("[0]", True), ("0.5", True)):
        assert one(spark, f'{{"abstain": {value}, "claims": []}}', answers.draft(F.col("t")))["abstain"] is truth
    assert one(spark, '{"claims": {"a": 1}}', answers.draft(F.col("t")))["claims"] == [] and one(spark, "{}", answers.draft(F.col("t")))["claims"] == []
    assert one(spark, "nope 'x'\n", answers.draft_problem(F.col("t"))) == answers.UNREADABLE + answers.BROKEN + repr("nope 'x'\n")
    assert one(spark, "[1]", answers.draft_problem(F.col("t"))) == answers.UNREADABLE + answers.ODD + "'[1]'" and one(spark, "{}", answers.draft_problem(F.col("t"))) is None
    judge = lambda raw: one(spark, raw, answers.verdicts(F.col("t"), F.lit(2)))
    assert [v.asDict() for v in judge('{"verdicts": [{"claim_id": 1.0, "supported": "false"}, {"claim_id": "2", "supported": 0, "reason": 7}, {"supported": true}, 3]}')] == [
        {"claim_id": 1, "supported": True, "reason": ""}, {"claim_id": 2, "supported": False, "reason": "7"},
    ]
    assert judge('{"verdicts": 3}') is None and judge("{}") is None and judge("no") is None and judge("[]") == []
    assert one(spark, '{"scores": [{"id": true, "score": 2.9}, {"id": 2, "score": "1.5"}]}', js.rerank_scores(F.col("t"), F.lit(3))) == {1: 2}
    text = "a\x0b\x1f\\u000B\"\n\x01é"
    import json

    assert one(spark, text, js.canonical(b=F.col("t"))) == json.dumps({"b": text}, ensure_ascii=False, separators=(",", ":"))


def test_citations_and_answer_machine(spark):
    claims = "array(named_struct('text', 'a', 'citations', array(1)), named_struct('text', 'b', 'citations', array(9)))"
    got = spark.range(1).select(verification.citation_problems(F.expr(claims), F.lit(3)).alias("p")).first()["p"]
    assert got == ["mệnh đề 2 trích dẫn [9] ngoài danh sách (chỉ có [1]..[3])"]
    attempts = spark.createDataFrame(
        [("a", 1, 1.0, False, True, 0.5), ("a", 2, 1.0, False, True, 1.0), ("b", 1, 0.0, False, True, 1.0), ("c", 1, None, True, False, None)],
        "qid string, attempt int, top_score double, abstained boolean, check_a boolean, ratio double",
    )
    grid = spark.createDataFrame([(0.5, 0.5), (0.5, 1.0)], "tau_r double, tau_g double")
    got = {(r["tau_g"], r["qid"]): (r["abstains"], r["accepted_at"]) for r in verification.answer_outcomes(attempts, grid).collect()}
    assert got[0.5, "a"] == (False, 1) and got[1.0, "a"] == (False, 2) and got[0.5, "b"][0] and got[0.5, "c"][0]


def test_attempts_after_the_end_count_nowhere(spark):
    rows = [("a", 1, 1.0, False, True, 0.6), ("a", 2, 1.0, False, True, 0.9), ("b", 1, 1.0, False, False, None), ("b", 2, 1.0, True, True, None), ("c", 1, 1.0, False, True, 0.1), ("c", 2, 1.0, False, False, None)]
    attempts = spark.createDataFrame(rows, "qid string, attempt int, top_score double, abstained boolean, check_a boolean, ratio double")
    got = {r["qid"]: r for r in verification.answer_outcomes(attempts, spark.createDataFrame([(0.5, 0.5)], "tau_r double, tau_g double")).collect()}
    assert (got["a"]["ratio_final"], got["a"]["accepted_at"], got["a"]["retried"]) == (0.6, 1, False)
    assert got["b"]["stage"] == "model" and got["c"]["stage"] == "check_a" and got["c"]["ratio_final"] == 0.1


def test_gated_questions_have_no_attempts(spark):
    rows = [("g", 1, 0.0, False, False, 0.5), ("g", 2, 0.0, False, True, 1.0), ("n", 1, None, False, False, None), ("n", 2, None, False, True, 0.4), ("m", 1, 0.9, True, True, None), ("k", 1, 0.9, False, True, 1.0)]
    attempts = spark.createDataFrame(rows, "qid string, attempt int, top_score double, abstained boolean, check_a boolean, ratio double")
    found = verification.answer_outcomes(attempts, spark.createDataFrame([(0.5, 0.5)], "tau_r double, tau_g double"))
    got = {r["qid"]: (r["stage"], r["n_attempts"], r["accepted_at"], r["ratio_first"], r["ratio_final"], r["retried"], r["n_check_a_failed"]) for r in found.collect()}
    assert got == {"g": ("retrieve", 0, None, None, None, False, 0), "n": ("check_b", 2, None, None, 0.4, True, 1), "m": ("model", 1, None, None, None, False, 0), "k": (None, 1, 1, 1.0, 1.0, False, 0)}
    stats = verification.faithfulness(found, ["tau_r"]).first().asDict()
    assert stats == {"tau_r": 0.5, "n_answered": 1, "n_abstained": 3, "ratio_first": 1.0, "ratio_final": 0.7, "n_retry": 1, "n_check_a_fail": 1, "at_retrieve": 1, "at_model": 1, "at_check_a": 0, "at_check_b": 1}


def test_citation_problems_go_claim_by_claim(spark):
    claims = F.expr("array(named_struct('text', 'a', 'citations', array(0, 1, 7)), named_struct('text', 'b', 'citations', cast(array() as array<int>)))")
    got = spark.range(1).select(verification.citation_problems(claims, F.lit(2)).alias("p")).first()["p"]
    assert [g[:9] for g in got] == ["mệnh đề 1"] * 2 + ["mệnh đề 2"] and "[0]" in got[0] and "[7]" in got[1]


def test_labels_and_context(spark):
    row = spark.range(1).select(
        answers.citation_label(F.lit("Luật A"), F.lit(9), F.lit("0"), F.lit(True)).alias("lead"), answers.citation_label(F.lit("Luật A"), F.lit(9), F.lit("0"), F.lit(False)).alias("whole"),
        answers.citation_label(F.lit("Luật A"), F.lit(9), answers.clause_range(F.lit(1), F.lit(3)), F.lit(False)).alias("range"),
        answers.context(F.array(F.struct(*(F.lit(v).alias(k) for k, v in {"label": "L", "title": "T", "doc_id": "d", "status": "expired", "effective_to": "2020", "text": " x \n"}.items()))), True).alias("context"),
    ).first()
    assert (row["lead"], row["whole"], row["range"]) == ("Điều 9 (đoạn mở đầu) Luật A", "Điều 9 Luật A", "Điều 9 Khoản 1-3 Luật A")
    assert row["context"] == "[1] L — T\n    văn bản: d · hiệu lực: expired, hết hiệu lực 2020\nx"


def test_drafts_and_verdicts(spark):
    raw = '{"claims": [{"text": " a ", "citations": ["2", "x", 9]}, {"text": ""}, 5]}'
    assert one(spark, raw, answers.draft(F.col("t")))["claims"][0].asDict() == {"text": "a", "citations": [2, 9]}
    assert len(one(spark, raw, answers.draft(F.col("t")))["claims"]) == 1
    assert one(spark, '{"abstain": true, "reason": "r", "claims": [{"text": "a"}]}', answers.draft(F.col("t"))).asDict() == {"abstain": True, "reason": "r", "claims": []}
    assert one(spark, "[1]", answers.draft(F.col("t"))) is None and one(spark, '{"a', answers.draft(F.col("t"))) is None
    judged = '[{"claim_id": 1, "supported": true}, {"claim_id": "1", "supported": false, "reason": "no"}, {"claim_id": 4, "supported": true}]'
    assert [v.asDict() for v in one(spark, judged, answers.verdicts(F.col("t"), F.lit(3)))] == [{"claim_id": 1, "supported": False, "reason": "no"}]
    with pytest.raises(Exception, match="no candidate was scored"):
        one(spark, '{"scores": []}', js.rerank_scores(F.col("t"), F.lit(3), strict=True))


def test_blanks_characters_and_tail(spark):
    assert one(spark, "\n\n\na \t b\t\n\n\n\nc\n\n", tx.squeeze_blanks(F.col("t"))) == "\na b\n\nc\n"
    assert one(spark, "\n\n", tx.squeeze_blanks(F.col("t"))) == ""
    assert one(spark, "\ufeff\u201ca\u2019\u2015\u00a0b\u00ad", tx.clean_characters(F.col("t"))) == "\"a'- b"
    body = "Căn cứ\nChương I QUY ĐỊNH\nĐiều 1. A\nPhụ lục: x\nsau"
    rows = structure.scope(structure.lines(spark.createDataFrame([("d", body)], "doc_id string, body string"))).orderBy("ln").collect()
    assert [r["line"] for r in rows] == ["Chương I QUY ĐỊNH", "Điều 1. A"]


def test_wanted_articles_against_parsed_ones(spark):
    parsed = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, article_no int")
    audit = gold.article_audit(spark.createDataFrame([("d", 2), ("d", 9)], "doc_id string, article_no int"), parsed).first()
    assert (audit["missing"], audit["extra"]) == ([9], [1, 3])


def test_cache_stream_records_each_digest_once(spark, tmp_path):
    from groundspark.streaming.cache import record_answers

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "digest string, response string, created_at string"
    for rows in ([("a", "1", ""), ("a", "1", "")], [("a", "2", ""), ("b", "3", "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        record_answers(spark.readStream.schema(schema).json(source), table, str(tmp_path / "state")).awaitTermination()
    assert sorted((r["digest"], r["response"]) for r in spark.read.parquet(table).collect()) == [("a", "1"), ("b", "3")]


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
