"""Answers replayed from recorded calls; conversations stand in for questions, their turns for what a model and a judge said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import answers
from groundspark.functions.text import strip
from groundspark.operators import replay
from groundspark.plans.retrieval import read
from groundspark.sources.tables import materialized

GENERATE = replay.Call("generate", "p", "writer", {"temperature": 0.0, "response_schema": replay.DRAFT_SHAPE})
JUDGE = replay.Call("judge", "p", "judge", {"temperature": 0.0})
TAU_R, TAU_G = 0.34, 0.67
_REST = {c.task: '},"model":"%s","params":%s,"prompt_version":1,"provider":"p","task":"%s"}' % (c.model, params, c.task) for c, params in (
    (GENERATE, '{"response_schema":{"properties":{"abstain":{"type":"boolean"},"claims":{"items":{"properties":{"citations":{"items":{"type":"integer"},"type":"array"},"text":{"type":"string"}},"required":["text","citations"],"type":"object"},"type":"array"},"reason":{"type":"string"}},"required":["abstain","claims"],"type":"object"},"temperature":0.0}'),
    (JUDGE, '{"temperature":0.0}'),
)}


def _said(text: Column) -> Column:
    """A text as JSON; texts hold no control characters but line feeds here."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, q (the first turn), n (chunks in its context), claims (text and citation of the other turns)."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", strip(F.coalesce("text", F.lit(""))).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    claims = F.transform(F.filter(F.slice("t", F.lit(2), F.size("t")), lambda x: x["text"] != ""), lambda x: F.struct(x["text"].alias("text"), (F.length(x["text"]) % 4 + 1).cast("int").alias("c")))
    return rows.select("conv_id", F.get("t", F.lit(0))["text"].alias("q"), (F.col("conv_id") % 3 + 2).cast("int").alias("n"), claims.alias("claims"))


def _recorded(rows: DataFrame) -> DataFrame:
    """(digest, response): what was recorded, under keys written out as text. Some drafts abstain, can't be read or are missing, and so on."""
    c, join = F.col("conv_id"), F.array_join
    ids = F.concat(F.lit("["), join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.lit('"doc'), c.cast("string"), F.lit("#a"), k.cast("string"), F.lit('#c0#p0"'))), ","), F.lit("]"))
    number = lambda i: (i + 1).cast("string")
    rows = rows.withColumns({"ids": ids, "qs": _said(F.col("q"))})
    written = F.concat(F.lit('{"abstain": false, "claims": ['), join(F.transform("claims", lambda x: F.concat(F.lit('{"text": '), _said(x["text"]), F.lit(', "citations": ['), x["c"].cast("string"), F.lit("]}"))), ", "), F.lit("]}"))
    first = F.when(c % 6 == 0, F.lit('{"abstain": true, "reason": "r"}')).when(c % 6 == 1, F.concat(F.lit("no json "), c.cast("string"))).otherwise(written)
    outside = F.filter(F.transform("claims", lambda x, i: F.when(x["c"] > F.col("n"), F.concat(F.lit("- mệnh đề "), number(i), F.lit(" trích dẫn ["), x["c"].cast("string"), F.lit("] ngoài danh sách (chỉ có [1]..["), F.col("n").cast("string"), F.lit("])")))), lambda x: x.isNotNull())
    rows = rows.withColumns({"draft1": first, "wrong": F.when(F.size("claims") == 0, F.array(F.lit("- không có mệnh đề nào"))).otherwise(outside)})
    skipped = lambda i: (c % 2 == 0) & (i == F.size("claims") - 1)  # noqa: E731  the judge says nothing of it
    verdict = lambda x, i: F.when(~skipped(i), F.concat(F.lit('{"claim_id": '), number(i), F.lit(', "supported": '), (F.length(x["text"]) % 3 != 0).cast("string"), F.lit(', "reason": "r'), number(i), F.lit('"}')))
    judged = F.concat(F.lit('{"verdicts": ['), join(F.filter(F.transform("claims", verdict), lambda x: x.isNotNull()), ", "), F.lit("]}"))
    reason = lambda i: F.when(skipped(i), answers.UNJUDGED).otherwise(F.concat(F.lit("r"), number(i)))
    bad = F.filter(F.transform("claims", lambda x, i: F.when(skipped(i) | (F.length(x["text"]) % 3 == 0), F.concat(F.lit('- "'), x["text"], F.lit('" — '), reason(i)))), lambda x: x.isNotNull())
    told = (
        F.when(c % 6 == 1, F.concat(F.lit(f"{answers.WRONG_CITATIONS}\n- {answers.UNREADABLE}{answers.BROKEN}'no json "), c.cast("string"), F.lit("'\n")))
        .when(F.size("wrong") > 0, F.concat(F.lit(f"{answers.WRONG_CITATIONS}\n"), join("wrong", "\n"), F.lit("\n")))
        .otherwise(F.concat(F.lit(f"{answers.UNSUPPORTED}\n"), join(bad, "\n"), F.lit("\n")))
    )
    second = F.concat(F.lit('{"claims": [{"text": '), _said(F.concat(F.get("claims", F.lit(0))["text"], F.lit(" (2)"))), F.lit(', "citations": [1]}]}'))
    again = F.concat(F.lit('so:\n```json\n[{"claim_id": 1, "supported": '), (c % 4 != 1).cast("string"), F.lit(', "reason": "s"}]\n```'))
    rows = rows.withColumns({"told": F.concat(told, F.lit(answers.MEND)), "judged": F.when(c % 13 == 4, "no").otherwise(judged)})
    key = lambda task, *parts: F.sha2(F.concat(F.lit('{"input":{'), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit(_REST[task])), 256)
    ask = lambda k, feedback: key("generate", f'"attempt":{k},"context":', F.col("ids"), ',"feedback":', feedback, ',"question":', F.col("qs"))
    judge = lambda cited, texts: key("judge", '"citations":[', cited, '],"claims":[', texts, '],"context":', F.col("ids"), ',"question":', F.col("qs"))
    cited = join(F.transform("claims", lambda x: F.concat(F.lit("["), x["c"].cast("string"), F.lit("]"))), ",")
    records = (
        (c % 11 != 5, ask(1, F.lit('""')), F.col("draft1")), (c % 7 != 3, judge(cited, join(F.transform("claims", lambda x: _said(x["text"])), ",")), F.col("judged")),
        ((c % 5 != 2) & (F.size("claims") > 0), ask(2, _said(F.col("told"))), second), (F.size("claims") > 0, judge(F.lit("[1]"), _said(F.concat(F.get("claims", F.lit(0))["text"], F.lit(" (2)")))), again),
    )
    each = F.array(*(F.when(kept, F.struct(digest.alias("digest"), response.alias("response"))) for kept, digest, response in records))
    return rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select("r.*").where("digest is not null")


def q_replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir)
    chunk = lambda k: F.struct(k.alias("rank"), F.concat(F.lit("doc"), F.col("conv_id").cast("string"), F.lit("#a"), k.cast("string"), F.lit("#c0#p0")).alias("chunk_id"), F.concat(F.lit("label "), k.cast("string")).alias("label"))
    asked = rows.select(F.col("conv_id").alias("qid"), F.col("q").alias("question"), F.transform(F.sequence(F.lit(1), F.col("n")), chunk).alias("context"), ((F.col("conv_id") % 4) / 3.0).alias("top_score"))
    made = replay.attempts(asked, materialized(_recorded(rows)), GENERATE, JUDGE)
    keys = made.groupBy("qid").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt", F.coalesce(c, F.lit("-")).alias("d")))), lambda x: x["d"]), ",").alias(c) for c in ("generate_digest", "judge_digest")))
    found = replay.answered(asked, made, TAU_R, TAU_G).join(keys, "qid")
    return found.select(
        "qid", "abstained", "stage", F.sha2("answer", 256).alias("answer_sha256"), F.array_join("citations", ";").alias("citations"), F.col("n_attempts").cast("long").alias("n_attempts"),
        F.round("ratio_first", 6).alias("ratio_first"), F.round("ratio_final", 6).alias("ratio_final"), "missing", "failed", "generate_digest", "judge_digest",
    )


QUERIES = {"replayed_answers": q_replayed_answers}
_JSON = lambda x: f"to_json({x})::VARCHAR"
_Q = lambda x: x.replace("'", "''")
_ASK = lambda k, feedback: f"""sha256('{{"input":{{"attempt":{k},"context":' || ids || ',"feedback":' || {feedback} || ',"question":' || {_JSON("q")} || '{_REST["generate"]}')"""
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
SQL = {
    "replayed_answers": f"""WITH t AS (SELECT conv_id, trim(coalesce(text, ''), {_WS}) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, trim(coalesce(text, ''), {_WS})) AS r FROM conversations),
b AS (SELECT conv_id AS c, conv_id % 3 + 2 AS n, (conv_id % 4) / 3.0::DOUBLE AS top, first(x ORDER BY r) AS q FROM t GROUP BY conv_id),
k AS (SELECT conv_id AS c, x, length(x) % 4 + 1 AS cite, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM t WHERE r > 1 AND x <> ''),
v AS (SELECT *, NOT (c % 2 = 0 AND i = m) AND length(x) % 3 <> 0 AS ok, CASE WHEN c % 2 = 0 AND i = m THEN '{answers.UNJUDGED}' ELSE 'r' || i END AS reason FROM k JOIN b USING (c)),
g AS (SELECT c, count(*) AS m, first(x ORDER BY i) || ' (2)' AS x1, avg(ok::INT) AS r1, string_agg('[' || cite || ']', ',' ORDER BY i) AS cites, string_agg({_JSON("x")}, ',' ORDER BY i) AS texts,
  string_agg('- mệnh đề ' || i || ' trích dẫn [' || cite || '] ngoài danh sách (chỉ có [1]..[' || n || '])', chr(10) ORDER BY i) FILTER (cite > n) AS wrong, string_agg('- "' || x || '" — ' || reason, chr(10) ORDER BY i) FILTER (NOT ok) AS bad,
  string_agg(x || ' [' || cite || ']', ' ' ORDER BY i) AS answer FROM v GROUP BY c),
l AS (SELECT c, string_agg('[' || cite || '] label ' || cite, ';' ORDER BY cite) AS labels FROM (SELECT DISTINCT c, cite FROM v WHERE cite <= n) GROUP BY c),
e AS (SELECT b.*, coalesce(m, 0) AS m, x1, r1, cites, texts, CASE WHEN m IS NULL THEN '- không có mệnh đề nào' ELSE wrong END AS wrong, bad, answer, labels, '[' || array_to_string(['"doc' || c || '#a' || k || '#c0#p0"' FOR k IN range(1, n + 1)], ',') || ']' AS ids FROM b LEFT JOIN g USING (c) LEFT JOIN l USING (c)),
f AS (SELECT *, c % 11 <> 5 AS has1, c % 6 = 0 AS declines, c % 6 = 1 AS broken, c % 6 > 1 AND wrong IS NULL AS a1, c % 7 <> 3 AS hasj1, c % 13 = 4 AS odd, CASE WHEN c % 6 = 1 THEN '{_Q(answers.WRONG_CITATIONS)}' || chr(10) || '- {_Q(answers.UNREADABLE + answers.BROKEN)}''no json ' || c || '''' || chr(10)
  WHEN wrong IS NOT NULL THEN '{_Q(answers.WRONG_CITATIONS)}' || chr(10) || wrong || chr(10) ELSE '{_Q(answers.UNSUPPORTED)}' || chr(10) || bad || chr(10) END || '{_Q(answers.MEND)}' AS told FROM e),
h AS (SELECT *, has1 AND NOT declines AND a1 AS judged, has1 AND NOT declines AND NOT (a1 AND (NOT hasj1 OR odd OR r1 = 1)) AS asks2, c % 5 <> 2 AND m > 0 AS has2 FROM f),
j AS (SELECT *, CASE WHEN judged AND hasj1 AND NOT odd THEN r1 END AS ratio1, asks2 AND has2 AS runs2, CASE WHEN c % 4 <> 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS r2, top < {TAU_R} AS gated FROM h),
o AS (SELECT *, coalesce(ratio1 >= {TAU_G}, false) AS acc1 FROM j),
p AS (SELECT *, NOT gated AND acc1 AS said1, NOT gated AND NOT acc1 AND runs2 AND r2 >= {TAU_G} AS said2, NOT gated AND NOT acc1 AND (NOT has1 OR (judged AND (NOT hasj1 OR odd)) OR (asks2 AND NOT has2)) AS stuck FROM o)
SELECT c AS qid, NOT (said1 OR said2) AS abstained, CASE WHEN gated THEN 'retrieve' WHEN stuck OR said1 OR said2 THEN NULL WHEN declines THEN 'model' ELSE 'check_b' END AS stage,
  sha256(CASE WHEN said1 THEN answer WHEN said2 THEN x1 || ' [1]' ELSE '{replay.ABSTAINS}' END) AS answer_sha256, CASE WHEN said1 THEN labels WHEN said2 THEN '[1] label 1' ELSE '' END AS citations,
  (CASE WHEN gated OR NOT has1 OR (judged AND (NOT hasj1 OR odd)) THEN 0 WHEN NOT acc1 AND runs2 THEN 2 ELSE 1 END)::BIGINT AS n_attempts, CASE WHEN NOT gated THEN round(ratio1, 6) END AS ratio_first,
  CASE WHEN gated THEN NULL WHEN NOT acc1 AND runs2 THEN r2 ELSE round(ratio1, 6) END AS ratio_final,
  CASE WHEN NOT stuck THEN NULL WHEN NOT has1 OR (asks2 AND NOT has2) THEN 'generate' WHEN NOT hasj1 THEN 'judge' END AS missing, stuck AND has1 AND judged AND hasj1 AND odd AS failed,
  {_ASK(1, """'""'""")} || CASE WHEN asks2 THEN ',' || {_ASK(2, _JSON("told"))} ELSE '' END AS generate_digest,
  CASE WHEN judged THEN sha256('{{"input":{{"citations":[' || cites || '],"claims":[' || texts || '],"context":' || ids || ',"question":' || {_JSON("q")} || '{_REST["judge"]}') ELSE '-' END
  || CASE WHEN runs2 THEN ',' || sha256('{{"input":{{"citations":[[1]],"claims":[' || {_JSON("x1")} || '],"context":' || ids || ',"question":' || {_JSON("q")} || '{_REST["judge"]}') WHEN asks2 THEN ',-' ELSE '' END AS judge_digest FROM p""",
}
