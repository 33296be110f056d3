"""Labels, drafts, verdicts and gold-set queries; documents, lines and conversations stand in for chunks and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import answers
from groundspark.operators import gold
from groundspark.plans.retrieval import read
from groundspark.plans.texts import _LINES, _lines


def q_citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk: clauses and article from its id, titles from its source and language."""
    no, first, last = F.col("doc_id") % 40 + 1, F.col("doc_id") % 5, F.col("doc_id") % 5 + F.col("doc_id") % 3
    docs = read(spark, sf_dir, "documents").select("doc_id", no.alias("no"), answers.clause_range(first, last).alias("clauses"), ((first == 0) & (F.col("doc_id") % 2 == 0)).alias("lead"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    label = answers.citation_label(F.coalesce("source", F.lit("?")), F.col("no"), F.col("clauses"), F.col("lead"))
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.coalesce("lang", F.lit("")))
    return docs.select(
        "doc_id", label.alias("label"), answers.short_label(F.col("no"), F.col("clauses"), F.col("lead")).alias("short_label"),
        answers.chunk_id(F.col("doc_id"), F.col("no"), F.col("clauses"), F.col("doc_id") % 2).alias("chunk_id"), F.sha2(answers.indexed_text(label, title, F.col("text")), 256).alias("indexed_sha256"),
    )


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw answer for each conversation: its turns as claims that cite 1, something unreadable and a number from their length."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    claim = F.struct("turn", "text", F.array(F.lit("1"), F.lit("x"), (F.length("text") % 6).cast("string")).alias("citations"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(claim)).alias("c"), F.sum(F.length("text")).alias("n"))
    said = F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["citations"].alias("citations")))
    whole = F.to_json(F.struct((F.col("n") % 7 == 0).alias("abstain"), said.alias("claims")))
    return grouped.select("conv_id", "n", F.when(F.col("n") % 11 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("raw"))


def q_draft_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_ = _drafts(spark, sf_dir).withColumn("d", answers.draft(F.col("raw")))
    labels = F.array(*(F.lit(f"label {k}") for k in range(1, 5)))
    return read_.select(
        "conv_id", F.col("d").isNull().alias("broken"), F.coalesce("d.abstain", F.lit(False)).alias("abstains"), F.coalesce(F.size("d.claims"), F.lit(0)).cast("long").alias("n_claims"),
        F.sha2(F.coalesce(answers.answer_text(F.col("d.claims")), F.lit("")), 256).alias("answer_sha256"),
        F.coalesce(F.array_join(answers.answer_labels(F.col("d.claims"), labels), ";"), F.lit("")).alias("labels"),
    )


def q_verdict_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's raw verdicts for each source's documents by label, the last one of a claim holding, and what a retry is told."""
    docs = read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("qid"), "doc_id", (F.col("doc_id") / 50).cast("long").alias("k"), "quality")
    item = F.struct("doc_id", (F.col("k") % 4 + 1).alias("claim_id"), (F.col("quality") == 1).alias("supported"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("reason"))
    raw = docs.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("v"))
    raw = raw.select("qid", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("v", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["supported"].alias("supported"), x["reason"].alias("reason"))).alias("verdicts"))), F.lit("\n```")).alias("raw"))
    found = raw.withColumn("v", answers.verdicts(F.col("raw"), F.lit(3)))
    rejected = F.transform(F.filter(F.array_sort("v"), lambda v: ~v["supported"]), lambda v: F.struct(F.concat(F.lit("claim "), v["claim_id"].cast("string")).alias("text"), v["reason"].alias("reason")))
    problems = F.when(F.col("qid") % 2 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))
    return found.select("qid", F.size("v").cast("long").alias("n_verdicts"), answers.retry_feedback(problems, rejected).alias("feedback"))


def q_gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    questions = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("answerable"))
    spans = questions.where("qid % 5 != 0").select("qid", F.when(F.col("qid") % 9 == 0, -F.col("qid")).otherwise(F.col("qid")).alias("doc_id"), (F.col("qid") % 300).alias("s"), (F.col("qid") % 300 + F.col("qid") % 97).alias("e"))
    return gold.gold_problems(questions, spans, docs)


def q_spans_in_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand in for articles; a span that crosses a line end lies in none."""
    lines = _lines(spark, sf_dir)
    docs = lines.groupBy("doc_id").agg(F.max("e").alias("n"))
    spans = docs.select(F.col("doc_id").alias("qid"), "doc_id", F.floor(F.col("n") / 3).cast("long").alias("s"), (F.floor(F.col("n") / 3) + 40).cast("long").alias("e"))
    found = gold.spans_in_articles(spans, lines.select("doc_id", F.col("ln").alias("article_seq"), (F.col("ln") + 1).cast("long").alias("article_no"), "s", "e"))
    return found.select("qid", "s", "e", "article_no")


def q_structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand in for headings by their number: every eighth a chapter, of the others each whose length is even an article, numbered by its length."""
    kind = F.when(F.col("ln") % 8 == 0, "chapter").when(F.length("line") % 2 == 0, "article").when(F.length("line") % 3 == 0, "clause").otherwise("text")
    found = gold.structure_counts(_lines(spark, sf_dir).select("doc_id", "ln", kind.alias("kind"), (F.col("ln") + F.length("line") % 3).cast("long").alias("article_no")))
    gaps = F.transform("gaps", lambda g: F.concat_ws("->", g["a"].cast("string"), g["b"].cast("string")))
    return found.select("doc_id", "n_chapters", "n_sections", "n_articles", "n_clauses", F.array_join(gaps, ",").alias("gaps"))


QUERIES = {
    "citation_labels": q_citation_labels, "draft_answers": q_draft_answers, "verdict_feedback": q_verdict_feedback, "gold_problems": q_gold_problems,
    "spans_in_articles": q_spans_in_articles, "structure_counts": q_structure_counts,
}
_MEND = answers.MEND.replace("'", "''")
SQL = {
    "citation_labels": """WITH c AS (SELECT doc_id, doc_id % 40 + 1 AS no, doc_id % 5 AS a, doc_id % 5 + doc_id % 3 AS b, coalesce(source, '?') AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(lang, '') END AS article, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS cl, a = 0 AND doc_id % 2 = 0 AS lead FROM c),
s AS (SELECT *, 'Điều ' || no || CASE WHEN lead THEN ' (đoạn mở đầu)' WHEN cl = '0' THEN '' ELSE ' Khoản ' || cl END AS short_label FROM l)
SELECT doc_id, short_label || ' ' || title AS label, short_label, doc_id || '#a' || no || '#c' || cl || '#p' || (doc_id % 2) AS chunk_id,
  sha256(short_label || ' ' || title || CASE WHEN article <> '' THEN ' — ' || article ELSE '' END || chr(10) || text) AS indexed_sha256 FROM s""",
    "draft_answers": r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
g AS (SELECT conv_id, sum(n) AS n FROM t GROUP BY conv_id),
k AS (SELECT t.*, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said, g.n % 11 = 0 AS broken, g.n % 7 = 0 AS abst FROM t JOIN g USING (conv_id)),
c AS (SELECT * FROM k WHERE said <> '' AND NOT broken AND NOT abst),
a AS (SELECT conv_id, count(*) AS n_claims, string_agg(said || ' [1][' || n % 6 || ']', ' ' ORDER BY turn, text) AS answer FROM c GROUP BY conv_id),
o AS (SELECT conv_id, string_agg('[' || o || '] label ' || o, ';' ORDER BY o) AS labels FROM (SELECT DISTINCT conv_id, unnest([1, n % 6]) AS o FROM c) WHERE o BETWEEN 1 AND 4 GROUP BY conv_id)
SELECT conv_id, n % 11 = 0 AS broken, n % 7 = 0 AND n % 11 <> 0 AS abstains, coalesce(n_claims, 0) AS n_claims, sha256(coalesce(answer, '')) AS answer_sha256, coalesce(labels, '') AS labels FROM g LEFT JOIN a USING (conv_id) LEFT JOIN o USING (conv_id)""",
    "verdict_feedback": f"""WITH d AS (SELECT doc_id % 50 AS qid, doc_id, (doc_id // 50) % 4 + 1 AS claim, quality = 1 AS ok FROM labels),
v AS (SELECT * FROM d WHERE claim <= 3 QUALIFY row_number() OVER (PARTITION BY qid, claim ORDER BY doc_id DESC) = 1),
r AS (SELECT qid, count(*) AS n, string_agg('- "claim ' || claim || '" — r' || doc_id, chr(10) ORDER BY claim) FILTER (NOT ok) AS bad FROM v GROUP BY qid)
SELECT qid, coalesce(n, 0) AS n_verdicts, CASE WHEN qid % 2 = 0 THEN '{answers.WRONG_CITATIONS}' || chr(10) || '- p' || chr(10) ELSE '' END
  || CASE WHEN bad IS NOT NULL THEN '{answers.UNSUPPORTED}' || chr(10) || bad || chr(10) ELSE '' END || '{_MEND}' AS feedback FROM (SELECT DISTINCT qid FROM d) LEFT JOIN r USING (qid)""",
    "gold_problems": """WITH q AS (SELECT doc_id AS qid, quality = 1 AS answerable FROM labels),
s AS (SELECT qid, CASE WHEN qid % 9 = 0 THEN -qid ELSE qid END AS doc_id, qid % 300 AS s, qid % 300 + qid % 97 AS e FROM q WHERE qid % 5 <> 0)
SELECT qid, CASE WHEN d.doc_id IS NULL THEN 'unknown document' ELSE 'span outside its document' END AS problem FROM s LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL OR s >= e OR e > length(coalesce(text, ''))
UNION ALL SELECT qid, CASE WHEN answerable THEN 'answerable without a span' ELSE 'a span though not answerable' END FROM q WHERE answerable = (qid % 5 = 0)""",
    "spans_in_articles": f"""WITH {_LINES}, d AS (SELECT doc_id, max(e) // 3 AS s FROM numbered GROUP BY doc_id)
SELECT d.doc_id AS qid, d.s, d.s + 40 AS e, (SELECT min(ln) + 1 FROM numbered n WHERE n.doc_id = d.doc_id AND n.s <= d.s AND d.s + 40 <= n.e) AS article_no FROM d""",
    "structure_counts": f"""WITH {_LINES}, k AS (SELECT doc_id, ln, ln + length(line) % 3 AS no, CASE WHEN ln % 8 = 0 THEN 'chapter' WHEN length(line) % 2 = 0 THEN 'article' WHEN length(line) % 3 = 0 THEN 'clause' ELSE 'text' END AS kind FROM numbered),
g AS (SELECT doc_id, string_agg(before || '->' || no, ',' ORDER BY ln) AS gaps FROM (SELECT *, lag(no) OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM k WHERE kind = 'article') WHERE no <> before + 1 GROUP BY doc_id)
SELECT doc_id, count_if(kind = 'chapter')::BIGINT AS n_chapters, 0::BIGINT AS n_sections, count_if(kind = 'article')::BIGINT AS n_articles, count_if(kind = 'clause')::BIGINT AS n_clauses, coalesce(any_value(gaps), '') AS gaps FROM k LEFT JOIN g USING (doc_id) GROUP BY doc_id""",
}
