"""Evaluation, verification and calibration over documents and labels, which stand in for answers and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.operators import intervals, reports, verification
from groundspark.operators.chunking import packed
from groundspark.plans.retrieval import read
from groundspark.plans.texts import _lines
from groundspark.sources.tables import materialized

DEPTH = 8


def _gold_and_ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each document is a question: two spans of its text are gold, its lines by length are the ranked chunks."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    third = lambda k: F.floor(F.col("n") * k / 3).cast("long")
    spans = docs.select("qid", "doc_id", F.explode(F.array(F.struct(F.lit(0).alias("span_ix"), F.lit(0).cast("long").alias("s"), third(1).alias("e")), F.struct(F.lit(1).alias("span_ix"), third(2).alias("s"), F.col("n").cast("long").alias("e")))).alias("x"))
    spans = spans.select("qid", "x.span_ix", "doc_id", "x.s", "x.e")
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy((F.col("e") - F.col("s")).desc(), "ln")
    ranked = _lines(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEPTH)
    return spans, ranked.select(F.col("doc_id").alias("qid"), "rank", "doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, ranked = _gold_and_ranked(spark, sf_dir)
    return intervals.coverage(spans, ranked, DEPTH)


def q_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("qid", F.col("span_ix").cast("long").alias("span_ix"), F.col("k").cast("long").alias("k"), F.round("cov", 6).alias("cov"))


def q_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("type"))
    report = intervals.retrieval_report(intervals.question_results(_curve(spark, sf_dir)), types, [1, 3, 5, DEPTH])
    return report.select(F.col("k").cast("long").alias("k"), F.coalesce("type", F.lit("all")).alias("type"), "n", "recall_strict", "recall_any", "mean_cov", "mrr")


def q_evaluate_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by length and lines in order as two arms, one arm that lacks a record and one without rows; four of five documents are answerable."""
    spans, by_length = _gold_and_ranked(spark, sf_dir)
    spans = spans.withColumn("span_ix", F.col("span_ix").cast("int"))
    in_order = _lines(spark, sf_dir).where(F.col("ln") < DEPTH).select(F.col("doc_id").alias("qid"), (F.col("ln") + 1).alias("rank"), "doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    arm = lambda df, name: df.select(F.lit(name).alias("arm"), "qid", "rank", F.col("rank").cast("string").alias("chunk_id"), "doc_id", "s", "e")
    ranked = arm(by_length, "length").unionByName(arm(in_order, "order")).unionByName(arm(in_order, "judged"))
    questions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("type"), (F.col("doc_id") % 5 != 0).alias("answerable"))
    missing = spark.createDataFrame([("judged", "no record")], "arm string, reason string")
    tables = reports.arm_results(materialized(spans), materialized(ranked), questions, ["length", "order", "judged", "none"], ks=(1, 3, DEPTH), missing=missing)
    cast = tables["arms"].select("arm", F.coalesce("type", F.lit("all")).alias("type"), F.col("k").cast("long").alias("k"), "n", "recall_strict", "recall_any", "mean_cov", "mrr")
    skipped = tables["skipped"].select("arm", F.col("reason").alias("type"), *(F.lit(None).cast(t).alias(c) for c, t in (("k", "long"), ("n", "long"), ("recall_strict", "double"), ("recall_any", "double"), ("mean_cov", "double"), ("mrr", "double"))))
    return cast.unionByName(skipped)


def q_chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand in for chunks; a document's status follows from its id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "expired").otherwise("active").alias("status"))
    lines = _lines(spark, sf_dir).select("doc_id", "ln", F.greatest(F.lit(1), F.length("line")).alias("n_tokens"))
    found = reports.chunk_report(docs, lines.where("ln % 3 = 1").select("doc_id"), lines)
    whole = ("n_documents", "n_articles", "n_chunks", "least", "most", "n_active", "n_expired")
    return found.select(*(F.col(c).cast("long").alias(c) for c in whole), *(F.round(c, 4).alias(c) for c in ("p25", "median", "p75", "active_share", "expired_share")), "skewed")


def q_greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand in for clauses: packed into groups of 120 to 600 tokens."""
    lines = _lines(spark, sf_dir).where("e > s").select("doc_id", F.struct(F.col("s").cast("int").alias("s"), (F.col("ln") + 1).alias("n"), F.col("e").cast("int").alias("e")).alias("c"))
    per = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    groups = per.select("doc_id", F.posexplode(packed(F.col("c"))).alias("i", "g"))
    return groups.select("doc_id", F.col("i").cast("long").alias("i"), F.col("g.s").cast("long").alias("s"), F.col("g.e").cast("long").alias("e"), F.col("g.split").alias("split"))


def q_citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand in for drafts: each turn is a claim that cites the turns before it by length."""
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    cited = F.when(F.length("text") % 5 == 0, F.expr("cast(array() as array<int>)")).otherwise(F.array((F.length("text") % 7).cast("int")))
    drafts = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t"), cited.alias("c")))), lambda x: F.struct(x["t"].alias("text"), x["c"].alias("citations"))).alias("claims"), F.count("*").alias("n"))
    found = drafts.withColumn("problems", verification.citation_problems(F.col("claims"), F.lit(4)))
    return found.select("conv_id", "n", F.size("problems").cast("long").alias("n_problems"), F.array_join("problems", ";").alias("problems"))


def q_support_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source stand in for claims, labels for verdicts."""
    claims = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("claim_id"))
    verdicts = claims.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), (F.col("quality") == 1).alias("supported")), "claim_id")
    return verification.support_ratio(claims, verdicts, ["source"]).select("source", "n_claims", F.round("support_ratio", 6).alias("support_ratio"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two attempts for each label: retrieval score, ratio and checks from doc_id, quality and toxic."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), "quality", "toxic")
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("qid") % 3 == 0, 2).otherwise(1))).alias("attempt"))
    return each.select(
        "qid", "attempt", ((F.col("qid") % 4) / 3.0).alias("top_score"), ((F.col("quality") == 0) & (F.col("qid") % 2 == 0)).alias("abstained"),
        (F.col("qid") % 11 != 0).alias("check_a"), F.when(F.col("qid") % 13 != 0, F.least(F.lit(1.0), (F.col("qid") % 8) / 8.0 + F.col("attempt") * 0.25)).alias("ratio"), (F.col("quality") == 0).alias("should_abstain"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    taus = lambda values, name: spark.createDataFrame([(float(v),) for v in values], f"{name} double")
    grid = taus(verification.TAU_RETRIEVE, "tau_r").join(taus(verification.TAU_GROUND, "tau_g"), how="cross")
    attempts = _attempts(spark, sf_dir)
    truth = attempts.where("attempt = 1").select("qid", "should_abstain")
    return verification.answer_outcomes(attempts, grid).join(truth, "qid")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(spark, sf_dir)
    point = ["tau_r", "tau_g"]
    ratios = outcomes.groupBy(*point).agg(F.round(F.avg("ratio_final"), 6).alias("ratio"), F.count_if("retried").alias("retries"))
    return verification.best_point(verification.abstention(outcomes, point).join(ratios, point))


def q_abstain_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("tau_r", "tau_g", "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


def q_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("tau_r", "tau_g", "ratio", "retries", "best", "plateau")


def q_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.faithfulness(_outcomes(spark, sf_dir), ["tau_r", "tau_g"])


def q_answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each question ends at each point of the grid."""
    found = _outcomes(spark, sf_dir)
    return found.select("tau_r", "tau_g", "qid", "stage", "abstains", "n_attempts", F.round("ratio_first", 6).alias("ratio_first"), F.round("ratio_final", 6).alias("ratio_final"), "n_check_a_failed")


def q_rollup_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return docs.rollup("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


def q_format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the leading bytes of what they hold, as binary files are told apart."""
    from groundspark.sources.corpus import detect_format

    files = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return detect_format(files).groupBy("format").agg(F.count("*").alias("n"))


from groundspark.plans.texts import _LINES  # noqa: E402

_COV = f"""WITH {_LINES},
ranked AS (SELECT * FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, ln) AS rank FROM numbered) WHERE rank <= 8),
n AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
spans AS (SELECT doc_id, 0 AS ix, 0 AS s, n // 3 AS e FROM n UNION ALL SELECT doc_id, 1, n * 2 // 3, n FROM n),
ks AS (SELECT unnest(range(1, 9)) AS k),
curve AS (SELECT p.doc_id AS qid, ix AS span_ix, k, CASE WHEN p.e > p.s THEN coalesce(sum(greatest(0, least(p.e, r.e) - greatest(p.s, r.s))), 0)::DOUBLE / (p.e - p.s) ELSE 0.0 END AS cov
  FROM spans p CROSS JOIN ks LEFT JOIN ranked r ON r.doc_id = p.doc_id AND r.rank <= k GROUP BY p.doc_id, ix, k, p.s, p.e)"""
_GRID = """WITH a AS (SELECT doc_id AS qid, quality, unnest(range(1, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END)) AS attempt FROM labels),
att AS (SELECT qid, attempt, (qid % 4) / 3.0::DOUBLE AS top, quality = 0 AND qid % 2 = 0 AS abst, qid % 11 != 0 AS ok, CASE WHEN qid % 13 != 0 THEN least(1.0::DOUBLE, (qid % 8) / 8.0::DOUBLE + attempt * 0.25::DOUBLE) END AS ratio, quality = 0 AS should FROM a),
p AS (SELECT f.qid, f.top, f.should, f.abst AS abst1, f.ok AS ok1, f.ratio AS r1, s.qid IS NOT NULL AS has2, coalesce(s.abst, false) AS abst2, coalesce(s.ok, false) AS ok2, s.ratio AS r2
  FROM att f LEFT JOIN att s ON s.qid = f.qid AND s.attempt = 2 WHERE f.attempt = 1),
grid AS (SELECT r.t AS tau_r, g.t AS tau_g FROM (SELECT unnest([0.0::DOUBLE, 0.34, 0.67, 1.0]) AS t) r, (SELECT unnest([0.0::DOUBLE, 0.25, 0.34, 0.5, 0.67, 0.75, 1.0]) AS t) g),
h AS (SELECT *, top < tau_r AS gated, NOT abst1 AND ok1 AND coalesce(r1 >= tau_g, false) AS acc1 FROM p, grid),
i AS (SELECT *, NOT gated AND has2 AND NOT abst1 AND NOT acc1 AS runs2, NOT abst2 AND ok2 AND coalesce(r2 >= tau_g, false) AS acc2 FROM h),
o AS (SELECT tau_r, tau_g, qid, should, gated OR NOT (acc1 OR (runs2 AND acc2)) AS ab, CASE WHEN gated THEN 0 WHEN runs2 THEN 2 ELSE 1 END AS ran, CASE WHEN NOT gated THEN r1 END AS ratio_first,
  CASE WHEN gated THEN NULL WHEN runs2 THEN coalesce(r2, r1) ELSE r1 END AS ratio_final, CASE WHEN gated THEN 0 ELSE (NOT ok1)::INT + (runs2 AND NOT ok2)::INT END AS a_failed,
  CASE WHEN gated THEN 'retrieve' WHEN abst1 OR (runs2 AND abst2) THEN 'model' WHEN acc1 OR (runs2 AND acc2) THEN NULL WHEN CASE WHEN runs2 THEN ok2 ELSE ok1 END THEN 'check_b' ELSE 'check_a' END AS stage FROM i),
c AS (SELECT tau_r, tau_g, count_if(should AND ab)::BIGINT AS tp, count_if(NOT should AND ab)::BIGINT AS fp, count_if(should AND NOT ab)::BIGINT AS fn, count_if(NOT should AND NOT ab)::BIGINT AS tn, round(avg(ratio_final), 6) AS ratio,
  count_if(ran > 1)::BIGINT AS retries FROM o GROUP BY ALL),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""

_ARMS = f"""{_COV},
ord AS (SELECT doc_id, s, e, ln + 1 AS rank FROM numbered WHERE ln < 8), arms AS (SELECT 'length' AS arm, * FROM ranked UNION ALL SELECT 'order', doc_id, s, e, rank FROM ord),
names AS (SELECT unnest(['length', 'order']) AS arm),
cv AS (SELECT a.arm, p.doc_id AS qid, ix, k, CASE WHEN p.e > p.s THEN coalesce(sum(greatest(0, least(p.e, r.e) - greatest(p.s, r.s))), 0)::DOUBLE / (p.e - p.s) ELSE 0.0 END AS cov
  FROM spans p CROSS JOIN ks CROSS JOIN names a LEFT JOIN arms r ON r.arm = a.arm AND r.doc_id = p.doc_id AND r.rank <= k WHERE p.doc_id % 5 <> 0 GROUP BY a.arm, p.doc_id, ix, k, p.s, p.e),
rs AS (SELECT arm, qid, CASE WHEN count(r) = count(*) THEN max(r) END AS r_star FROM (SELECT arm, qid, ix, min(CASE WHEN cov >= 0.8 THEN k END) AS r FROM cv GROUP BY ALL) GROUP BY arm, qid),
qs AS (SELECT arm, qid, k, bool_and(cov >= 0.8) AS strict, bool_or(cov >= 0.8) AS any_hit, avg(cov) AS mean_cov FROM cv WHERE k IN (1, 3, 8) GROUP BY ALL)"""
_PACK = f"""WITH RECURSIVE {_LINES},
c AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i, greatest(1, round((e - s) / 3.5)) > 600 AS split FROM numbered WHERE e > s),
f AS (SELECT doc_id, i, 0 AS g, s AS gs, e AS ge, split AS alone FROM c WHERE i = 1
  UNION ALL SELECT doc_id, i, CASE WHEN fits THEN g ELSE g + 1 END, CASE WHEN fits THEN gs ELSE s END, e, split FROM (
    SELECT c.*, f.g, f.gs, NOT f.alone AND NOT c.split AND greatest(1, round((f.ge - f.gs) / 3.5)) < 120 AND greatest(1, round((c.e - f.gs) / 3.5)) <= 600 AS fits FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1)),
g AS (SELECT doc_id, g, min(gs) AS s, max(ge) AS e, bool_or(alone) AS alone FROM f GROUP BY doc_id, g),
l AS (SELECT *, lead(g) OVER w IS NULL AND g > 0 AS last, lag(alone) OVER w AS before_alone, lag(s) OVER w AS before_s FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
m AS (SELECT *, last AND NOT alone AND NOT before_alone AND greatest(1, round((e - s) / 3.5)) < 120 AND greatest(1, round((e - before_s) / 3.5)) <= 600 AS joins FROM l)
SELECT doc_id, (g - joins::INT)::BIGINT AS i, min(s)::BIGINT AS s, max(e)::BIGINT AS e, bool_or(alone) AS split FROM m GROUP BY doc_id, g - joins::INT"""

QUERIES = {
    "evaluate_arms": q_evaluate_arms, "chunk_report": q_chunk_report,
    "coverage_curve": q_coverage_curve, "recall_mrr": q_recall_mrr, "greedy_pack": q_greedy_pack, "citation_check": q_citation_check, "support_ratio": q_support_ratio,
    "abstain_f1": q_abstain_f1, "grid_best": q_grid_best, "faithfulness": q_faithfulness, "answer_outcomes": q_answer_outcomes, "rollup_by_type": q_rollup_by_type, "format_counts": q_format_counts,
}
SQL = {
    "evaluate_arms": f"""{_ARMS}
SELECT arm, coalesce(lang, 'all') AS type, k, count(*) AS n, round(avg(strict::INT), 4) AS recall_strict, round(avg(any_hit::INT), 4) AS recall_any, round(avg(mean_cov), 4) AS mean_cov, round(avg(coalesce(1.0 / r_star, 0)), 4)::DOUBLE AS mrr
FROM qs JOIN rs USING (arm, qid) JOIN documents d ON d.doc_id = qid GROUP BY GROUPING SETS ((arm, k), (arm, k, lang))
UNION ALL SELECT * FROM (VALUES ('judged', 'no record', NULL, NULL, NULL, NULL, NULL, NULL), ('none', 'no rows', NULL, NULL, NULL, NULL, NULL, NULL))""",
    "chunk_report": f"""WITH {_LINES}, c AS (SELECT ln, greatest(1, length(line)) AS n, doc_id % 3 = 0 AS x FROM numbered)
SELECT (SELECT count(*) FROM documents) AS n_documents, count_if(ln % 3 = 1)::BIGINT AS n_articles, count(*) AS n_chunks, min(n) AS least, max(n) AS most, count_if(NOT x)::BIGINT AS n_active, count_if(x)::BIGINT AS n_expired,
  round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.75), 4) AS p75, round(100.0::DOUBLE * count_if(NOT x) / count(*), 1) AS active_share, round(100.0::DOUBLE * count_if(x) / count(*), 1) AS expired_share,
  quantile_cont(n, 0.75) > 3 * quantile_cont(n, 0.5) AS skewed FROM c""",
    "greedy_pack": _PACK,
    "coverage_curve": f"{_COV} SELECT qid, span_ix::BIGINT AS span_ix, k, round(cov, 6) AS cov FROM curve",
    "recall_mrr": f"""{_COV},
r AS (SELECT qid, CASE WHEN count(r) = count(*) THEN max(r) END AS r_star FROM (SELECT qid, span_ix, min(CASE WHEN cov >= 0.8 THEN k END) AS r FROM curve GROUP BY ALL) GROUP BY qid),
q AS (SELECT qid, k, bool_and(cov >= 0.8) AS strict, bool_or(cov >= 0.8) AS any_hit, avg(cov) AS mean_cov FROM curve WHERE k IN (1, 3, 5, 8) GROUP BY ALL)
SELECT k, coalesce(lang, 'all') AS type, count(*) AS n, round(avg(strict::INT), 4) AS recall_strict, round(avg(any_hit::INT), 4) AS recall_any, round(avg(mean_cov), 4) AS mean_cov, round(avg(coalesce(1.0 / r_star, 0)), 4)::DOUBLE AS mrr
FROM q JOIN r USING (qid) JOIN documents d ON d.doc_id = qid GROUP BY GROUPING SETS ((k), (k, lang))""",
    "citation_check": """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, length(text) AS n FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, i, CASE WHEN n % 5 = 0 THEN format('mệnh đề {} không có trích dẫn', i) WHEN n % 7 NOT BETWEEN 1 AND 4 THEN format('mệnh đề {} trích dẫn [{}] ngoài danh sách (chỉ có [1]..[4])', i, n % 7) END AS problem FROM t)
SELECT conv_id, count(*) AS n, count(problem) AS n_problems, coalesce(string_agg(problem, ';' ORDER BY i) FILTER (problem IS NOT NULL), '') AS problems FROM p GROUP BY conv_id""",
    "support_ratio": """SELECT source, count(*) AS n_claims, round(avg(coalesce(quality = 1, false)::INT), 6) AS support_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "abstain_f1": f"{_GRID} SELECT tau_r, tau_g, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "grid_best": f"""{_GRID} SELECT tau_r, tau_g, ratio, retries, row_number() OVER (ORDER BY -round(f1, 4), fn, -round(coalesce(ratio, 0), 4), tau_r, tau_g) = 1 AS best, round(f1, 4) = max(round(f1, 4)) OVER () AS plateau FROM f""",
    "faithfulness": f"""{_GRID} SELECT tau_r, tau_g, count_if(NOT ab)::BIGINT AS n_answered, count_if(ab)::BIGINT AS n_abstained, round(avg(ratio_first), 4) AS ratio_first, round(avg(ratio_final), 4) AS ratio_final, count_if(ran > 1)::BIGINT AS n_retry,
  sum(a_failed)::BIGINT AS n_check_a_fail, count_if(stage = 'retrieve')::BIGINT AS at_retrieve, count_if(stage = 'model')::BIGINT AS at_model, count_if(stage = 'check_a')::BIGINT AS at_check_a, count_if(stage = 'check_b')::BIGINT AS at_check_b FROM o GROUP BY tau_r, tau_g""",
    "answer_outcomes": f"{_GRID} SELECT tau_r, tau_g, qid, stage, ab AS abstains, ran::BIGINT AS n_attempts, round(ratio_first, 6) AS ratio_first, round(ratio_final, 6) AS ratio_final, a_failed::BIGINT AS n_check_a_failed FROM o",
    "rollup_by_type": "SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)",
    "format_counts": """SELECT CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN regexp_extract(url, '\\.([^.]+)$', 1) IN ('pdf', 'doc', 'docx') THEN lower(regexp_extract(url, '\\.([^.]+)$', 1)) ELSE 'unknown' END AS format, count(*) AS n FROM pages GROUP BY 1""",
}
