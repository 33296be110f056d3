"""Checks of cited answers, the answer machine over recorded attempts, abstention figures, threshold grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the thresholds that are tried.
TAU_RETRIEVE = (0.0, 0.34, 0.67, 1.0)
TAU_GROUND = (0.0, 0.25, 0.34, 0.5, 0.67, 0.75, 1.0)
#: Where a question can end without an answer.
STAGES = ("retrieve", "model", "check_a", "check_b")


#: Fixed: what is said of a claim's citations.
NO_CLAIM, CLAIM, UNCITED, CITES, OUTSIDE = "không có mệnh đề nào", "mệnh đề ", " không có trích dẫn", " trích dẫn [", "] ngoài danh sách (chỉ có [1]..["


def citation_problems(claims: Column, n_context: Column) -> Column:
    """Problems of claims (array of struct text, citations), claim by claim: none at all, one without a citation, each ordinal out of 1..n."""
    n = n_context.cast("string")

    def of_claim(c: Column, i: Column) -> Column:
        out = F.filter(c["citations"], lambda o: (o < 1) | (o > n_context))
        said = F.transform(out, lambda o: F.concat(F.lit(CLAIM), (i + 1).cast("string"), F.lit(CITES), o.cast("string"), F.lit(OUTSIDE), n, F.lit("])")))
        return F.when(F.size(c["citations"]) == 0, F.array(F.concat(F.lit(CLAIM), (i + 1).cast("string"), F.lit(UNCITED)))).otherwise(said)

    return F.when(F.size(claims) == 0, F.array(F.lit(NO_CLAIM))).otherwise(F.flatten(F.transform(claims, of_claim)))


def support_ratio(claims: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Supported share of claims (key, claim_id); a claim without a verdict (key, claim_id, supported) isn't supported."""
    joined = claims.join(verdicts, [*key, "claim_id"], "left")
    return joined.groupBy(*key).agg(F.avg(F.coalesce(F.col("supported"), F.lit(False)).cast("int")).alias("support_ratio"), F.count("*").alias("n_claims"))


def answer_outcomes(attempts: DataFrame, grid: DataFrame) -> DataFrame:
    """What the answer machine does at each grid point, from attempts recorded once.

    attempts: qid, attempt, top_score (null for arms without a judge), abstained, check_a, ratio (null when not scored).
    A question whose top_score is under tau_r ends at retrieval: it has no attempts and no ratios. Otherwise attempts run
    in turn until one abstains or is accepted (check A holds and ratio >= tau_g); what was recorded after that did not
    run and counts nowhere. stage tells where a question ends without an answer: retrieve, model when an attempt
    abstains, else the check that the last attempt failed.
    """
    each = attempts.join(F.broadcast(grid), how="cross")
    ok = ~F.col("abstained") & F.col("check_a") & (F.coalesce("ratio", F.lit(-1.0)) >= F.col("tau_g"))
    point = ["tau_r", "tau_g", "qid"]
    gated = F.coalesce(F.col("top_score") < F.col("tau_r"), F.lit(False))
    each = each.withColumns({"ok": ok, "end": F.min(F.when(ok | F.col("abstained"), F.col("attempt"))).over(Window.partitionBy(*point))})
    each = each.withColumns({"gated": gated, "ran": ~gated & (F.col("end").isNull() | (F.col("attempt") <= F.col("end")))})
    ran = lambda x: F.when(F.col("ran"), x)
    by = each.groupBy(*point).agg(
        F.bool_or("gated").alias("gated"),
        F.coalesce(F.bool_or(ran(F.col("abstained"))), F.lit(False)).alias("declined"),
        F.min(ran(F.when(F.col("ok"), F.col("attempt")))).alias("accepted_at"),
        F.count_if("ran").alias("n_attempts"),
        F.count_if(F.col("ran") & ~F.col("check_a")).alias("n_check_a_failed"),
        F.max_by("check_a", ran(F.col("attempt"))).alias("_a"),
        F.min_by("ratio", ran(F.col("attempt"))).alias("ratio_first"),
        F.max_by("ratio", ran(F.when(F.col("ratio").isNotNull(), F.col("attempt")))).alias("ratio_final"),
    )
    last = F.when(F.col("_a"), "check_b").otherwise("check_a")
    stage = F.when(F.col("gated"), "retrieve").when(F.col("declined"), "model").when(F.col("accepted_at").isNull(), last)
    return by.withColumns({"abstains": F.col("accepted_at").isNull(), "stage": stage, "retried": F.col("n_attempts") > 1}).drop("_a")


def faithfulness(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Answered and abstained questions, mean first and last support ratio (null without any), retries, failed checks A, and abstentions by stage."""
    at = lambda stage: F.count_if(F.col("stage") == stage).alias(f"at_{stage}")
    return outcomes.groupBy(*keys).agg(
        F.count_if(~F.col("abstains")).alias("n_answered"), F.count_if("abstains").alias("n_abstained"),
        F.round(F.avg("ratio_first"), 4).alias("ratio_first"), F.round(F.avg("ratio_final"), 4).alias("ratio_final"),
        F.count_if("retried").alias("n_retry"), F.sum("n_check_a_failed").alias("n_check_a_fail"), *map(at, STAGES),
    )


def abstention(outcomes: DataFrame, keys: list[str], should: str = "should_abstain", does: str = "abstains") -> DataFrame:
    """Confusion counts, precision, recall and F1 with abstaining as the positive class; empty denominators give 0."""
    count = lambda a, b: F.count_if((F.col(should) == a) & (F.col(does) == b))
    c = outcomes.groupBy(*keys).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    c = c.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def best_point(grid: DataFrame) -> DataFrame:
    """The grid with best (least of -F1, missed, -ratio, taus) and plateau (F1 equal to the best); F1 and ratio count to four digits."""
    f1 = F.round("f1", 4)
    rank = F.struct(-f1, F.col("fn"), -F.round(F.coalesce("ratio", F.lit(0.0)), 4), F.col("tau_r"), F.col("tau_g"))
    whole = Window.partitionBy(F.lit(0))  # a grid is a few dozen rows
    top = grid.withColumn("_k", rank).withColumn("_b", F.min("_k").over(whole))
    return top.withColumns({"best": F.col("_k") == F.col("_b"), "plateau": f1 == F.max(f1).over(whole)}).drop("_k", "_b")
