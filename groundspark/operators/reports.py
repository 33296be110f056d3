"""Reports as tables: what each arm, question, grid point and chunk came to, nested where a reader wants it so, in a fixed order.

A report is a handful of tables that Spark writes as JSON lines, so neither the driver nor one task holds its questions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators import intervals, verification

K_VALUES, THETA = (1, 3, 5, 8, 10, 20, 30), 0.8
#: Fixed: the kinds of questions in the order in which a showcase has them.
SHOWN = ("factoid_1hop", "multihop", "distractor", "unanswerable_oos", "unanswerable_nearmiss")
SKEWED = 3


def arm_results(spans: DataFrame, ranked: DataFrame, questions: DataFrame, arms: Sequence[str], ks: Sequence[int] = K_VALUES, theta: float = THETA, missing: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables arms, questions and skipped of an evaluation.

    spans (qid, span_ix, doc_id, s, e), ranked (arm, qid, rank, chunk_id, doc_id, s, e), questions (qid, type, answerable).
    missing (arm, reason) names arms that can't be evaluated, as a recorded call is missing: they are skipped, as are
    arms without any row, and the others are reported. Only answerable questions count; means are over questions.
    arms: arm, theta, depth, type (null for all), n, k, recall_strict, recall_any, mean_cov, mrr.
    questions: arm, qid, type, r_star, mrr, spans (doc_id, char_start, char_end, r_star, cov by k), ranked_chunk_ids.
    """
    depth = max(ks)
    asked = questions.where("answerable").select("qid", "type")
    known = ranked.select("arm").distinct().withColumn("_some", F.lit(True))
    every = ranked.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
    reasons = (missing if missing is not None else every.limit(0).withColumn("reason", F.lit(""))).groupBy("arm").agg(F.min("reason").alias("_reason"))
    state = every.join(known, "arm", "left").join(reasons, "arm", "left")
    skipped = state.where("_some is null or _reason is not null").select("arm", F.coalesce("_reason", F.lit("no rows")).alias("reason"))
    held = ranked.join(F.broadcast(state.where("_some and _reason is null").select("arm")), "arm", "left_semi")
    # an arm's question is a question of its own
    pair = lambda df: df.withColumn("qid", F.struct("arm", "qid"))
    of_arms = F.broadcast(state.where("_some and _reason is null").select("arm"))
    each = asked.join(of_arms, how="cross")  # a few arms
    own = spans.join(asked.select("qid"), "qid", "left_semi").join(of_arms, how="cross")
    curve = intervals.coverage(pair(own).drop("arm"), pair(held).drop("arm"), depth)
    results = intervals.question_results(curve, theta)
    # a question without spans is covered nowhere
    scored = pair(each.select("arm", "qid", "type")).join(results.where(F.col("k").isin(list(ks))), "qid", "left")
    grid = F.explode(F.array(*map(F.lit, ks))).alias("_k")
    filled = scored.where("k is not null").unionByName(scored.where("k is null").select("qid", "arm", "type", grid, "strict", "any_hit", "mean_cov", "r_star").withColumnRenamed("_k", "k").select(*scored.columns))
    mean = lambda c: F.round(F.avg(c), 4)
    share = lambda c: mean(F.coalesce(F.col(c).cast("int"), F.lit(0)))
    rows = filled.select(F.col("qid.arm").alias("arm"), "type", "k", "strict", "any_hit", "mean_cov", "r_star")
    measures = (
        F.count("*").alias("n"), share("strict").alias("recall_strict"), share("any_hit").alias("recall_any"), mean(F.coalesce("mean_cov", F.lit(0.0))).alias("mean_cov"),
        mean(F.coalesce(1 / F.col("r_star"), F.lit(0.0))).alias("mrr"),
    )
    total = rows.groupBy("arm", "k").agg(*measures).withColumn("type", F.lit(None).cast("string"))
    by_type = rows.groupBy("arm", "k", "type").agg(*measures)
    table = total.unionByName(by_type).select("arm", F.lit(theta).alias("theta"), F.lit(depth).alias("depth"), "type", "n", "k", "recall_strict", "recall_any", "mean_cov", "mrr")
    return {"arms": table, "questions": _question_rows(each, own, curve, results, held, ks, theta), "skipped": skipped}


def _question_rows(each: DataFrame, spans: DataFrame, curve: DataFrame, results: DataFrame, ranked: DataFrame, ks: Sequence[int], theta: float) -> DataFrame:
    at = curve.select(F.col("qid.arm").alias("arm"), F.col("qid.qid").alias("qid"), "span_ix", "k", "cov")
    pairs = F.array_sort(F.collect_list(F.when(F.col("k").isin(list(ks)), F.struct("k", F.round("cov", 4).alias("cov")))))
    per_span = at.groupBy("arm", "qid", "span_ix").agg(F.min(F.when(F.col("cov") >= theta, F.col("k"))).alias("r_star"), F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"].cast("string"), p["cov"]))).alias("cov"))
    joined = spans.join(per_span, ["arm", "qid", "span_ix"], "left")
    item = F.struct("span_ix", "doc_id", F.col("s").alias("char_start"), F.col("e").alias("char_end"), "r_star", "cov")
    listed = _by_place(joined, item)
    stars = results.select(F.col("qid.arm").alias("arm"), F.col("qid.qid").alias("qid"), "r_star").distinct()
    order = ranked.where(F.col("rank") <= max(ks)).groupBy("arm", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ranked_chunk_ids"))
    rows = each
    for part in (stars, listed, order):
        rows = rows.join(part, ["arm", "qid"], "left")
    return rows.select("arm", "qid", "type", "r_star", F.round(F.coalesce(1 / F.col("r_star"), F.lit(0.0)), 6).alias("mrr"), "spans", "ranked_chunk_ids")


def _by_place(joined: DataFrame, item: Column) -> DataFrame:
    """Spans of a question in order; maps can't be compared, so the place is sorted and the spans are fetched by it."""
    got = joined.groupBy("arm", "qid").agg(F.collect_list(item).alias("x"))
    places = F.array_sort(F.transform("x", lambda x, i: F.struct(x["span_ix"].alias("ix"), i.alias("i"))))
    return got.select("arm", "qid", F.transform(places, lambda p: F.get("x", p["i"])).alias("spans"))


def answer_report(questions: DataFrame, answered: DataFrame, made: DataFrame, arm: str, tau_r: float, tau_g: float) -> dict[str, DataFrame]:
    """The tables summary and questions of answered questions.

    questions (qid, question, type, answerable), answered and made as `replay` gives them. summary: arm, tau_r, tau_g,
    abstain (confusion, precision, recall, f1) and faithfulness (with abstentions by stage). questions: each answer with
    its attempts in order, those that ran.
    """
    rows = questions.join(answered, "qid")
    marked = rows.select(F.lit(arm).alias("arm"), (~F.col("answerable")).alias("should_abstain"), F.col("abstained").alias("abstains"))
    confusion = verification.abstention(marked, ["arm"])
    stats = verification.faithfulness(rows.select(F.lit(arm).alias("arm"), F.col("abstained").alias("abstains"), "stage", "ratio_first", "ratio_final", (F.col("n_attempts") > 1).alias("retried"), "qid", "n_attempts")
        .join(_failed_checks(made), "qid", "left").withColumn("n_check_a_failed", F.size(F.filter(F.coalesce("_failed_at", F.array().cast("array<int>")), lambda a: a <= F.col("n_attempts")))), ["arm"])
    four = lambda c: F.round(c, 4).alias(c)
    abstain = F.struct(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), *map(four, ("precision", "recall", "f1")))
    faithful = F.struct(*(F.col(c) for c in stats.columns if c != "arm"))
    summary = confusion.join(stats, "arm").select("arm", F.lit(float(tau_r)).alias("tau_r"), F.lit(float(tau_g)).alias("tau_g"), abstain.alias("abstain"), faithful.alias("faithfulness"))
    attempt = F.struct("attempt", "abstained", "reason", "claims", "problems", "check_a", "verdicts", "ratio")
    tries = made.where("missing is null and not failed").groupBy("qid").agg(F.array_sort(F.collect_list(attempt)).alias("_tries"))
    each = rows.join(tries, "qid", "left").join(made.groupBy("qid").agg(F.max("top_score").alias("retrieval_score")), "qid", "left")
    ran = F.filter(F.coalesce("_tries", F.array().cast(tries.schema["_tries"].dataType)), lambda t: t["attempt"] <= F.col("n_attempts"))
    order = ("qid", "question", "type", "answerable", "answer", "citations", "abstained", "stage", "retrieval_score", "ratio_first", "ratio_final", "n_attempts", "missing", "failed")
    return {"summary": summary, "questions": each.select(*order, ran.alias("attempts"))}


def _failed_checks(made: DataFrame) -> DataFrame:
    return made.where("missing is null and not failed and not check_a").groupBy("qid").agg(F.collect_list("attempt").alias("_failed_at"))


def calibration_report(outcomes: DataFrame) -> dict[str, DataFrame]:
    """The tables grid and best of outcomes (tau_r, tau_g, qid, should_abstain, abstains, stage, ratios, ...): each point, the best one, and how many are as good."""
    point = ["tau_r", "tau_g"]
    stats = verification.faithfulness(outcomes, point)
    points = verification.best_point(verification.abstention(outcomes, point).join(stats, point).withColumn("ratio", F.col("ratio_final")))
    four = lambda c: F.round(c, 4).alias(c)
    grid = points.select(
        *point, F.struct(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), *map(four, ("precision", "recall", "f1"))).alias("abstain"),
        F.struct(*(F.col(c) for c in stats.columns if c not in point)).alias("faithfulness"), "best", "plateau",
    )
    size = F.count_if("plateau").over(Window.partitionBy(F.lit(0)))  # a grid is a few dozen rows
    return {"grid": grid, "best": grid.withColumn("plateau_size", size).where("best").drop("best", "plateau")}


_RECORD = (
    "chunk_id", "doc_id", "doc_title", "doc_type", "status", "effective_from", "effective_to", "chapter", "section", "article_no", "article_title", "clause_range", "citation_label",
    "char_start", "char_end", "n_tokens", "is_lead_in", "text",
)


def chunk_manifest(chunks: DataFrame, docs: DataFrame, settings: dict) -> dict[str, DataFrame]:
    """The tables settings (one row, with n_chunks) and chunks of a manifest; chunks as `chunking.chunks` makes them, docs with their metadata.

    A chunk_id that occurs twice is an error when rows are read.
    """
    from groundspark.functions.answers import citation_label

    meta = docs.select("doc_id", F.col("title").alias("doc_title"), "doc_type", "status", "effective_from", "effective_to")
    rows = chunks.join(meta, "doc_id").withColumnsRenamed({"title": "article_title", "s": "char_start", "e": "char_end"})
    rows = rows.withColumn("citation_label", citation_label(F.col("doc_title"), F.col("article_no"), F.col("clause_range"), F.col("is_lead_in")))
    twice = F.raise_error(F.concat(F.lit("repeated chunk_id "), "chunk_id")).cast("string")
    once = F.when(F.count("*").over(Window.partitionBy("chunk_id")) == 1, F.col("chunk_id")).otherwise(twice)
    held = rows.withColumn("chunk_id", once).select(*_RECORD)
    described = rows.agg(F.count("*").alias("n_chunks")).select(*(F.lit(v).alias(k) for k, v in settings.items()), "n_chunks")
    return {"settings": described, "chunks": held}


def chunk_report(docs: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, articles, chunks, percentiles of n_tokens, chunks by status with their share in percent, and skewed, where p75 is over SKEWED medians.

    docs (doc_id, status), articles (doc_id), chunks (doc_id, n_tokens). Percentiles are exact and interpolated; 0 without chunks.
    """
    of = lambda p: F.coalesce(F.percentile("n_tokens", F.lit(p)), F.lit(0.0))
    status = chunks.select("doc_id", "n_tokens").join(docs.select("doc_id", "status"), "doc_id", "left")
    counted = lambda s: F.count_if(F.col("status") == s)
    share = lambda s: F.when(F.count("*") > 0, F.round(100.0 * counted(s) / F.count("*"), 1)).otherwise(0.0)
    row = status.agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.min("n_tokens"), F.lit(0)).alias("least"), of(0.25).alias("p25"), of(0.5).alias("median"), of(0.75).alias("p75"), F.coalesce(F.max("n_tokens"), F.lit(0)).alias("most"),
        counted("active").alias("n_active"), share("active").alias("active_share"), counted("expired").alias("n_expired"), share("expired").alias("expired_share"),
    )
    skewed = (F.col("median") > 0) & (F.col("p75") > SKEWED * F.col("median"))
    counts = docs.agg(F.count("*").alias("n_documents")).join(articles.agg(F.count("*").alias("n_articles")), how="cross")  # a row each
    return counts.join(row, how="cross").withColumn("skewed", skewed)


def showcase(questions: DataFrame, arm: str, tau_r: float, tau_g: float, kinds: Sequence[str] = SHOWN) -> DataFrame:
    """One row, text: the first question of each kind of an answer report, in the kinds' order, as Markdown."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))
    first = questions.where(F.col("type").isin(list(kinds))).withColumn("_turn", F.row_number().over(Window.partitionBy("type").orderBy("qid"))).where("_turn = 1")
    cited = F.when(F.size("citations") > 0, F.concat(F.lit("\n**Sources.**\n"), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("- `"), c, F.lit("`"))), "\n"), F.lit("\n"))).otherwise("")
    ratio = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" · {name}: "), F.format_string("%.3f", F.col(c).cast("double")))).otherwise("")
    ended = F.when(F.col("abstained"), F.concat(F.lit("**declined** at `"), F.coalesce("stage", F.lit("?")), F.lit("`"))).otherwise("**answered**")
    detail = F.concat(F.lit("\n<sub>"), ended, ratio("ratio_first", "support before checks"), ratio("ratio_final", "after"), F.lit(" · attempts: "), F.col("n_attempts").cast("string"), F.lit("</sub>\n"))
    block = F.concat(F.lit(". "), F.col("qid").cast("string"), F.lit(" — `"), "type", F.lit("`\n\n**Question.** "), "question", F.lit("\n\n**Answer.** "), "answer", F.lit("\n"), cited, detail)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), block.alias("b")))).alias("x"))
    numbered = F.transform("x", lambda x, i: F.concat(F.lit("---\n\n## "), (i + 1).cast("string"), x["b"]))
    head = f"# Sample answers\n\nArm `{arm}`, thresholds {tau_r} at retrieval and {tau_g} for support; read from the answer report.\n\n"
    return listed.select(F.concat(F.lit(head), F.array_join(numbered, "\n")).alias("text"))
