"""Recorded model calls joined by digest: rerank scores, drafts, verdicts, and the attempts that follow from them.

A call is known by the SHA-256 of its canonical JSON, so a recorded answer is found by a join on that digest. A second
attempt's key holds what the first one was told, so attempts are built in turn, two joins each. Calls that nothing was
recorded for are rows that say so, not errors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions import answers
from groundspark.functions.json import canonical, digest, rerank_scores
from groundspark.operators.ranking import fuse
from groundspark.operators.verification import answer_outcomes, citation_problems
from groundspark.sources.tables import materialized

ATTEMPTS = 2
#: Fixed: what an answer says that is none, and the shapes that drafts and rerank scores are asked for in, as they are part of a call's key.
ABSTAINS = "Không đủ căn cứ trong tài liệu."
DRAFT_SHAPE = {
    "type": "object",
    "properties": {
        "abstain": {"type": "boolean"},
        "reason": {"type": "string"},
        "claims": {"type": "array", "items": {"type": "object", "properties": {"text": {"type": "string"}, "citations": {"type": "array", "items": {"type": "integer"}}}, "required": ["text", "citations"]}},
    },
    "required": ["abstain", "claims"],
}
SCORES_SHAPE = {
    "type": "object",
    "properties": {"scores": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "integer"}, "score": {"type": "integer"}}, "required": ["id", "score"]}}},
    "required": ["scores"],
}


@dataclass(frozen=True)
class Call:
    """What all calls of a task have in common."""

    task: str
    provider: str
    model: str
    params: dict = field(default_factory=dict)
    version: int = 1

    def payload(self, **inputs: Column) -> Column:
        """The canonical JSON of a call with these inputs."""
        rest = json.dumps({"model": self.model, "params": self.params, "prompt_version": self.version, "provider": self.provider, "task": self.task}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return F.concat(F.lit('{"input":'), canonical(**inputs), F.lit(f",{rest[1:]}"))


def looked_up(calls: DataFrame, payload: Column, cache: DataFrame, name: str) -> DataFrame:
    """calls with {name}_digest and {name}_raw, what the cache (digest, response) has for it, null for a miss or a null payload.

    Of several records of one digest the least response holds.
    """
    once = cache.groupBy(F.col("digest").alias(f"{name}_digest")).agg(F.min("response").alias(f"{name}_raw"))
    return calls.withColumn(f"{name}_digest", digest(payload)).join(once, f"{name}_digest", "left")


def reranked(candidates: DataFrame, cache: DataFrame, call: Call, depth: int = 30, top: int = 3) -> DataFrame:
    """The first `depth` candidates (qid, question, rank, chunk_id, indexed_text, ...) of each question by recorded scores.

    Adds fused_rank, rerank_score (0 to 1; a candidate that wasn't scored has 0) and problem: "missing" where no call is
    recorded, "unreadable" where its answer scores no candidate. Such questions keep their order and have no scores.
    The key is made of the candidates in order, so it is gathered for each question: `depth` rows at most.
    """
    cut = candidates.where(F.col("rank") <= depth).withColumnRenamed("rank", "fused_rank")
    listed = F.array_sort(F.collect_list(F.struct("fused_rank", "chunk_id", "indexed_text")))
    asked = cut.groupBy("qid", "question").agg(listed.alias("c"))
    of = lambda name: F.transform("c", lambda x: x[name])
    payload = call.payload(question=F.col("question"), candidates=of("chunk_id"), candidates_digest=answers.candidate_digest(of("indexed_text")))
    found = looked_up(asked, payload, cache, "rerank").withColumn("scores", rerank_scores(F.col("rerank_raw"), F.size("c"), top))
    problem = F.when(F.col("rerank_raw").isNull(), "missing").when(F.col("scores").isNull(), "unreadable")
    places = found.select("qid", "rerank_digest", problem.alias("problem"), "scores", F.posexplode(of("fused_rank")).alias("place", "fused_rank"))
    score = F.when(F.col("problem").isNull(), F.coalesce(F.try_element_at("scores", F.col("place") + 1), F.lit(0)) / F.lit(float(top)))
    scored = cut.join(places.select("qid", "fused_rank", "rerank_digest", "problem", score.alias("rerank_score")), ["qid", "fused_rank"])
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order))


def contexts(ranked: DataFrame, k: int = 8) -> DataFrame:
    """(qid, question, context, top_score): the first k ranked chunks (qid, question, rank, chunk_id, label, rerank_score or none) of each question."""
    score = F.col("rerank_score") if "rerank_score" in ranked.columns else F.lit(None).cast("double")
    cut = ranked.where(F.col("rank") <= k).select("qid", "question", "rank", F.struct("rank", "chunk_id", "label").alias("c"), score.cast("double").alias("s"))
    return cut.groupBy("qid", "question").agg(F.array_sort(F.collect_list("c")).alias("context"), F.min_by("s", "rank").alias("top_score"))


_ATTEMPT = (
    "qid", "attempt", "top_score", "generate_digest", "judge_digest", "missing", "failed", "abstained", "reason", "claims", "problems", "check_a", "verdicts", "ratio", "feedback",
)


def _attempted(asked: DataFrame, cache: DataFrame, generate: Call, judge: Call, number: int) -> DataFrame:
    """One attempt of each question (qid, question, context, top_score, feedback); a question without its draft has a row that names the miss."""
    ids = F.transform("context", lambda c: c["chunk_id"])
    drafted = looked_up(asked, generate.payload(question=F.col("question"), context=ids, attempt=F.lit(number), feedback=F.col("feedback")), cache, "generate")
    none = F.expr("cast(array() as array<struct<text:string,citations:array<bigint>>>)")
    drafted = drafted.withColumns({"draft": answers.draft(F.col("generate_raw")), "broken": answers.draft_problem(F.col("generate_raw"))})
    drafted = drafted.withColumns({"abstained": F.coalesce("draft.abstain", F.lit(False)), "claims": F.coalesce("draft.claims", none), "reason": F.coalesce("draft.reason", F.lit(""))})
    told = F.array().cast("array<string>")
    problems = F.when(F.col("generate_raw").isNull() | F.col("abstained"), told).when(F.col("broken").isNotNull(), F.array("broken")).otherwise(citation_problems(F.col("claims"), F.size("context")))
    drafted = drafted.withColumn("problems", problems).withColumn("check_a", F.size("problems") == 0)
    judged_now = F.col("generate_raw").isNotNull() & ~F.col("abstained") & F.col("check_a")
    payload = judge.payload(question=F.col("question"), claims=F.transform("claims", lambda c: c["text"]), citations=F.transform("claims", lambda c: c["citations"]), context=ids)
    rows = looked_up(drafted.withColumn("judged_now", judged_now), F.when(judged_now, payload), cache, "judge")
    rows = rows.withColumn("verdicts", answers.judged(answers.verdicts(F.col("judge_raw"), F.size("claims")), F.size("claims")))
    ratio = F.size(F.filter("verdicts", lambda v: v["supported"])) / F.size("verdicts")
    rejected = F.transform(F.filter(F.coalesce("verdicts", F.array().cast("array<struct<claim_id:int,supported:boolean,reason:string>>")), lambda v: ~v["supported"]), lambda v: F.struct(F.get("claims", v["claim_id"] - 1)["text"].alias("text"), v["reason"].alias("reason")))
    missing = F.when(F.col("generate_raw").isNull(), "generate").when(F.col("judged_now") & F.col("judge_raw").isNull(), "judge")
    rows = rows.withColumns({
        "attempt": F.lit(number), "missing": missing, "failed": F.coalesce(F.col("judge_raw").isNotNull() & F.col("verdicts").isNull(), F.lit(False)),
        "ratio": F.when(F.col("verdicts").isNotNull(), ratio), "told": answers.retry_feedback(F.col("problems"), rejected),
    })
    return rows.select(*(F.col(c) for c in _ATTEMPT), "question", "context", "told")


def attempts(asked: DataFrame, cache: DataFrame, generate: Call, judge: Call, most: int = ATTEMPTS) -> DataFrame:
    """Recorded attempts of questions (qid, question, context, top_score), a row each.

    A first attempt tells the model nothing; the next one is made where the draft couldn't be read, its citations are
    wrong or a claim isn't supported, whatever threshold is asked for later, and is told why. missing names the call
    that isn't recorded ("generate", "judge"), failed is true where the judge's answer can't be read; both end a
    question's attempts. Each attempt is written before the next one is built on it.
    """
    now = asked.withColumn("feedback", F.lit(""))
    done = []
    for number in range(1, most + 1):
        found = materialized(_attempted(now, cache, generate, judge, number))
        done.append(found.select(*_ATTEMPT))
        again = F.col("missing").isNull() & ~F.col("failed") & ~F.col("abstained") & ~F.coalesce(F.col("check_a") & (F.col("ratio") == 1.0), F.lit(False))
        now = found.where(again).select("qid", "question", "context", "top_score", F.col("told").alias("feedback"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def answered(asked: DataFrame, made: DataFrame, tau_r: float, tau_g: float) -> DataFrame:
    """(qid, abstained, stage, answer, citations, n_attempts, ratio_first, ratio_final, missing, failed), a row for each question asked.

    made is `attempts` of these questions. Questions without context end at retrieval. Where a call that the thresholds
    need is missing, or the judge can't be read, there is no answer and no stage: missing or failed says why.
    """
    spark = asked.sparkSession
    grid = spark.createDataFrame([(float(tau_r), float(tau_g))], "tau_r double, tau_g double")
    ends = answer_outcomes(made.where("missing is null and not failed"), grid).drop("tau_r", "tau_g")
    gaps = made.where("missing is not null or failed").select("qid", F.col("attempt").alias("gap_at"), F.col("missing").alias("gap"), F.col("failed").alias("gap_failed"), F.coalesce(F.col("top_score") < tau_r, F.lit(False)).alias("gap_gated"))
    taken = made.select("qid", F.col("attempt").alias("accepted_at"), F.col("claims").alias("_claims"))
    rows = asked.select("qid", F.size("context").alias("_n"), F.transform("context", lambda c: c["label"]).alias("_labels"))
    rows = rows.join(ends, "qid", "left").join(taken, ["qid", "accepted_at"], "left").join(gaps, "qid", "left")
    # a gap matters only where the question gets to it: not after an accepted or declined attempt, nor where it is gated
    open_ = F.col("gap_at").isNotNull() & ~F.col("gap_gated") & F.col("accepted_at").isNull() & ~F.coalesce("declined", F.lit(False))
    empty = F.coalesce(F.col("_n"), F.lit(0)) == 0
    gated = empty | F.coalesce("gated", "gap_gated", F.lit(False))
    said = F.col("accepted_at").isNotNull() & ~empty
    stage = F.when(gated, "retrieve").when(~open_, F.col("stage"))
    return rows.select(
        "qid", (~said).alias("abstained"), stage.alias("stage"), F.when(said, answers.answer_text(F.col("_claims"))).otherwise(ABSTAINS).alias("answer"),
        F.when(said, answers.answer_labels(F.col("_claims"), F.col("_labels"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(gated, 0).otherwise(F.coalesce("n_attempts", F.lit(0))).alias("n_attempts"), F.when(~gated, F.col("ratio_first")).alias("ratio_first"), F.when(~gated, F.col("ratio_final")).alias("ratio_final"),
        F.when(open_ & ~gated, F.col("gap")).alias("missing"), (open_ & ~gated & F.coalesce("gap_failed", F.lit(False))).alias("failed"),
    )


def fused_chunks(arms: dict[str, DataFrame], chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates for `reranked`: fused ranked lists (qid, chunk_id, rank) with the chunks' (chunk_id, label, indexed_text) and the question's text."""
    return fuse(arms, "qid", "chunk_id").join(chunks, "chunk_id").join(questions.select("qid", "question"), "qid")
