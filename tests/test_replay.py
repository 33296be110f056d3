"""Recorded calls: keys, drafts, verdicts, attempts and answers against a plain state machine; recorded rerank scores."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from groundspark.functions import answers
from groundspark.operators import replay

GEN = replay.Call("generate", "p", "m", {"b": 1, "a": [0.0, "é"]})
JUDGE = replay.Call("judge", "p", "m2")
RERANK = replay.Call("rerank", "p", "m3", {"response_schema": replay.SCORES_SHAPE})


def key(call, **inputs):
    payload = {"provider": call.provider, "model": call.model, "task": call.task, "input": inputs, "params": call.params, "prompt_version": call.version}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_keys_are_those_of_canonical_json(spark):
    rows = spark.createDataFrame([("a \"q\" \\ \n\t\x0b\x1f é", ["x", "y\\u000B"], [[1, 2], []])], "q string, ids array<string>, c array<array<int>>")
    got = rows.select(F.sha2(GEN.payload(question=F.col("q"), context=F.col("ids"), citations=F.col("c"), attempt=F.lit(1), none=F.lit(None).cast("int")), 256).alias("d")).first()["d"]
    r = rows.first()
    assert got == key(GEN, question=r["q"], context=r["ids"], citations=r["c"], attempt=1, none=None)


def machine(question, context, score, cache, tau_r, tau_g):
    """What happens to one question, call by call: (stage, answer, citations, ratios, missing, failed)."""
    n, feedback, ratios = len(context), "", []
    if not n or (score is not None and score < tau_r):
        return "retrieve", None, [], 0, None, None
    for attempt in (1, 2):
        raw = cache.get(key(GEN, question=question, context=[c[1] for c in context], attempt=attempt, feedback=feedback))
        if raw is None:
            return "missing", "generate", [], len(ratios), *ends(ratios)
        try:
            value = json.loads(raw)
            odd = None if isinstance(value, dict) else answers.ODD
        except ValueError:
            value, odd = None, answers.BROKEN
        if odd:
            problems, verdicts, claims, ok = [answers.UNREADABLE + odd + repr(raw[:200])], [], [], False
            ratios.append(None)
        else:
            if value.get("abstain"):
                return "model", None, [], len(ratios) + 1, *ends([*ratios, None])
            claims = [(c["text"].strip(), c["citations"]) for c in value.get("claims", []) if c["text"].strip()]
            problems = [] if claims else ["không có mệnh đề nào"]
            for i, (_, cites) in enumerate(claims, 1):
                problems += [f"mệnh đề {i} không có trích dẫn"] if not cites else [f"mệnh đề {i} trích dẫn [{c}] ngoài danh sách (chỉ có [1]..[{n}])" for c in cites if not 1 <= c <= n]
            ok, verdicts = not problems, []
            if ok:
                raw = cache.get(key(JUDGE, question=question, claims=[c[0] for c in claims], citations=[c[1] for c in claims], context=[c[1] for c in context]))
                if raw is None:
                    return "missing", "judge", [], len(ratios), *ends(ratios)
                try:
                    found = {v["claim_id"]: v for v in json.loads(raw)["verdicts"]}
                except ValueError:
                    return "failed", None, [], len(ratios), *ends(ratios)
                verdicts = [found.get(i, {"supported": False, "reason": answers.UNJUDGED}) for i in range(1, len(claims) + 1)]
                ratios.append(sum(bool(v["supported"]) for v in verdicts) / len(verdicts))
                if ratios[-1] >= tau_g:
                    used = sorted({c for _, cites in claims for c in cites})
                    return None, " ".join(t + " " + "".join(f"[{c}]" for c in cites) for t, cites in claims), [f"[{o}] {context[o - 1][2]}" for o in used], len(ratios), *ends(ratios)
            else:
                ratios.append(None)
        lines = ["Lượt trước sai về trích dẫn:", *(f"- {p}" for p in problems)] if problems else []
        bad = [(c[0], v["reason"]) for c, v in zip(claims, verdicts, strict=False) if not v["supported"]]
        lines += ["Lượt trước có mệnh đề không được trích đoạn hỗ trợ:", *(f'- "{t}" — {r}' for t, r in bad)] if bad else []
        feedback = "\n".join([*lines, answers.MEND])
        last = "check_b" if ok else "check_a"
    return last, None, [], len(ratios), *ends(ratios)


def ends(ratios):
    some = [r for r in ratios if r is not None]
    return (ratios[0] if ratios else None), (some[-1] if some else None)


def simulated(rng, q):
    """Context and recorded answers of a question, made along the way that the machine would go."""
    context = [(k + 1, f"c{q}#{k}", f"label {k}") for k in range(rng.choice([0, 2, 3]))]
    question, cache, feedback = f"question {q} \"?\"", {}, ""
    for attempt in (1, 2):
        claims = [{"text": f" claim {q} {i} '\"\n ", "citations": [rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.choice([1, 1, 1, 2, 0]))]} for i in range(rng.choice([0, 1, 2, 3]))]
        draft = rng.choice([json.dumps({"abstain": False, "claims": claims})] * 8 + ['{"abstain": true, "reason": "r"}', "it's no json\n", '[1, "x"]'])
        if rng.random() < 0.92:
            cache[key(GEN, question=question, context=[c[1] for c in context], attempt=attempt, feedback=feedback)] = draft
        said = [(c["text"].strip(), c["citations"]) for c in claims]
        verdicts = [{"claim_id": i, "supported": rng.random() < 0.7, "reason": f"r{i}"} for i in range(1, len(said) + 1) if rng.random() < 0.9]
        if rng.random() < 0.92:
            judge = key(JUDGE, question=question, claims=[c[0] for c in said], citations=[c[1] for c in said], context=[c[1] for c in context])
            cache[judge] = rng.choice([json.dumps({"verdicts": verdicts})] * 9 + ["broken {"])
        if attempt == 1:  # the second key needs what the first attempt leads to
            problems, bad = [], []
            try:
                value = json.loads(draft)
                if not isinstance(value, dict):
                    problems = [answers.UNREADABLE + answers.ODD + repr(draft[:200])]
                elif not value.get("abstain"):
                    problems = [] if said else ["không có mệnh đề nào"]
                    for i, (_, cites) in enumerate(said, 1):
                        problems += [f"mệnh đề {i} không có trích dẫn"] if not cites else [f"mệnh đề {i} trích dẫn [{c}] ngoài danh sách (chỉ có [1]..[{len(context)}])" for c in cites if not 1 <= c <= len(context)]
                    found = {v["claim_id"]: v for v in verdicts}
                    bad = [] if problems else [(t, found.get(i, {"reason": answers.UNJUDGED})["reason"]) for i, (t, _) in enumerate(said, 1) if not found.get(i, {}).get("supported")]
            except ValueError:
                problems = [answers.UNREADABLE + answers.BROKEN + repr(draft[:200])]
            lines = [answers.WRONG_CITATIONS, *(f"- {p}" for p in problems)] if problems else []
            lines += [answers.UNSUPPORTED, *(f'- "{t}" — {r}' for t, r in bad)] if bad else []
            feedback = "\n".join([*lines, answers.MEND])
    return question, context, rng.choice([None, 0.0, 1 / 3, 1.0]), cache


@pytest.mark.parametrize("tau_r, tau_g", [(0.0, 1.0), (0.34, 0.5)])
def test_answers_against_a_state_machine(spark, tau_r, tau_g):
    rng = random.Random(3)
    made = [simulated(rng, q) for q in range(150)]
    cache = {k: v for m in made for k, v in m[3].items()}
    asked = spark.createDataFrame([(q, m[0], m[1], m[2]) for q, m in enumerate(made)], "qid int, question string, context array<struct<rank:int,chunk_id:string,label:string>>, top_score double")
    table = spark.createDataFrame(list(cache.items()), "digest string, response string")
    tried = replay.attempts(asked.where("size(context) > 0"), table, GEN, JUDGE)
    rows = {r["qid"]: r for r in replay.answered(asked, tried, tau_r, tau_g).collect()}
    assert len(rows) == len(made)
    seen = set()
    for q, (question, context, score, _) in enumerate(made):
        stage, said, labels, n, first, final = machine(question, context, score, cache, tau_r, tau_g)
        seen.add(stage)
        r = rows[q]
        got = (r["stage"], r["missing"], r["failed"], r["abstained"], r["citations"], r["n_attempts"], r["ratio_first"], r["ratio_final"])
        state = (None if stage in ("missing", "failed") else stage, said if stage == "missing" else None, stage == "failed")
        assert got == (*state, stage is not None, labels, n, first, final), (q, stage)
        assert r["answer"] == (said if stage is None else replay.ABSTAINS)
    assert seen | {"check_b"} == {"retrieve", "model", "check_a", "check_b", "missing", "failed", None} and ("check_b" in seen or tau_g < 1)


def test_no_questions_and_no_records(spark):
    asked = spark.createDataFrame([(1, "q", [(1, "c", "l")], None)], "qid int, question string, context array<struct<rank:int,chunk_id:string,label:string>>, top_score double")
    empty = spark.createDataFrame([], "digest string, response string")
    row = replay.answered(asked, replay.attempts(asked, empty, GEN, JUDGE), 0.0, 1.0).first()
    assert (row["abstained"], row["stage"], row["missing"], row["n_attempts"]) == (True, None, "generate", 0)
    none = asked.limit(0)
    assert replay.answered(none, replay.attempts(none, empty, GEN, JUDGE), 0.0, 1.0).count() == 0


def test_recorded_rerank_scores(spark):
    chunks = [(k, f"c{k}", f"text {k}") for k in range(1, 6)]
    rows = [(q, f"q{q}", k, c, t) for q in range(4) for k, c, t in chunks]
    candidates = spark.createDataFrame(rows, "qid int, question string, rank int, chunk_id string, indexed_text string").repartition(3)
    sha = hashlib.sha256("\n".join(t for _, _, t in chunks[:4]).encode()).hexdigest()
    asked = lambda q: key(RERANK, question=f"q{q}", candidates=[c for _, c, _ in chunks[:4]], candidates_digest=sha)
    scores = '{"scores": [{"id": 3, "score": 9}, {"id": 2, "score": 1}, {"id": 4, "score": 1}, {"id": 7, "score": 3}]}'
    cache = spark.createDataFrame([(asked(0), scores), (asked(1), '{"scores": []}'), (asked(2), '[{"id": 4, "score": "2"}]')], "digest string, response string")
    found = replay.reranked(candidates, cache, RERANK, depth=4).orderBy("qid", "rank").collect()
    order = {q: [(r["fused_rank"], r["rerank_score"], r["problem"]) for r in found if r["qid"] == q] for q in range(4)}
    assert order[0] == [(3, 1.0, None), (2, 1 / 3, None), (4, 1 / 3, None), (1, 0.0, None)]
    assert order[1] == [(k, None, "unreadable") for k in range(1, 5)] and order[3] == [(k, None, "missing") for k in range(1, 5)]
    assert order[2][0] == (4, 2 / 3, None)
    labelled = spark.createDataFrame([(r["qid"], r["question"], r["rank"], r["chunk_id"], "l", r["rerank_score"]) for r in found], "qid int, question string, rank int, chunk_id string, label string, rerank_score double")
    top = {r["qid"]: (r["top_score"], len(r["context"])) for r in replay.contexts(labelled, 2).collect()}
    assert top == {0: (1.0, 2), 1: (None, 2), 2: (2 / 3, 2), 3: (None, 2)}


def test_many_verdicts_of_few_claims_take_no_quadratic_time(spark):
    """The last verdict of a claim holds; 8,000 of them are read in seconds, not with all others for each."""
    said = [{"claim_id": k % 7, "supported": k % 2 == 0, "reason": f"r{k}"} for k in range(8000)]
    raw = spark.createDataFrame([(json.dumps({"verdicts": said}),), ('{"verdicts": []}',), ("broken",)], "raw string")
    began = time.monotonic()
    rows = [r["v"] for r in raw.select(answers.verdicts(F.col("raw"), F.lit(3)).alias("v")).collect()]
    assert time.monotonic() - began < 30
    last = {v["claim_id"]: v for v in said}
    want = sorted((v["reason"], k, v["supported"]) for k, v in last.items() if 1 <= k <= 3)
    assert [(v["reason"], v["claim_id"], v["supported"]) for v in rows[0]] == want and rows[1:] == [[], None]
