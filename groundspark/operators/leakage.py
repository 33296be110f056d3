"""How much of a question's wording stands in the text that answers it, and gold spans held against documents and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions.answers import short_label
from groundspark.functions.text import jaccard, nfc, tokens

#: A higher overlap of words is a leak.
MOST = 0.3


def placed_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans (qid, span_ix, doc_id, s, e) with problem and text: "unknown document", "not whole numbers", "outside of the document", else null and the text."""
    joined = spans.join(docs.select("doc_id", F.coalesce("body", F.lit("")).alias("_body")), "doc_id", "left")
    problem = (
        F.when(F.col("_body").isNull(), "unknown document")
        .when(F.col("s").isNull() | F.col("e").isNull(), "not whole numbers")
        .when(~((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.length("_body"))), "outside of the document")
    )
    text = F.when(problem.isNull(), F.substring("_body", F.col("s") + 1, F.col("e") - F.col("s")))
    return joined.select("qid", "span_ix", "doc_id", "s", "e", problem.alias("problem"), text.alias("text"))


def validated_spans(spans: DataFrame, docs: DataFrame, clauses: DataFrame, preview: int = 120) -> DataFrame:
    """(qid, span_ix, doc_id, s, e, problem, label, preview): each gold span, what is wrong with it or else where it lies and how it begins.

    A span has to lie in the hull of one article's clauses (doc_id, article_seq, article_no, clause_no, s, e), the first
    that holds it; "in no single article" otherwise. The label is that of the clause where it begins, or the article's.
    """
    placed = placed_spans(spans, docs)
    hull = clauses.groupBy("doc_id", "article_seq").agg(F.min("s").alias("_from"), F.max("e").alias("_to"), F.min("article_no").alias("article_no"), F.max("clause_no").alias("_most"))
    fine = placed.where("problem is null")
    inside = fine.join(hull, "doc_id").where((F.col("_from") <= F.col("s")) & (F.col("e") <= F.col("_to")))
    key = ["qid", "span_ix", "doc_id", "s", "e"]
    first = inside.groupBy(*key).agg(F.min(F.struct("article_seq", "article_no", "_most")).alias("_a"))
    own = clauses.select("doc_id", F.col("article_seq").alias("_seq"), "clause_no", F.col("s").alias("_cs"), F.col("e").alias("_ce"))
    at = first.join(own, "doc_id").where((F.col("_seq") == F.col("_a.article_seq")) & (F.col("_cs") <= F.col("s")) & (F.col("s") < F.col("_ce"))).select(*key, "clause_no")
    rows = placed.join(first, key, "left").join(at, key, "left")
    problem = F.coalesce("problem", F.when(F.col("_a").isNull(), "in no single article"))
    number = F.coalesce("clause_no", F.lit(0))
    label = short_label(F.col("_a.article_no"), number.cast("string"), (F.col("clause_no") == 0) & (F.col("_a._most") > 0))
    cut = F.concat(F.replace(F.substring("text", 1, preview), F.lit("\n"), F.lit(" ")), F.when(F.length("text") > preview, "…").otherwise(""))
    return rows.select(*key, problem.alias("problem"), F.when(F.col("_a").isNotNull(), label).alias("label"), F.when(problem.isNull(), cut).alias("preview"))


def question_leakage(questions: DataFrame, spans: DataFrame, docs: DataFrame, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(qid, score, leaks), highest score first, and (qid, reason) of what was left out.

    questions (qid, question, answerable); the score is the Jaccard overlap of the question's words with those of all
    its usable spans (qid, span_ix, doc_id, s, e) together. Unanswerable questions aren't measured; spans that can't be
    placed and questions without any usable one are left out and said so.
    """
    asked = questions.where("answerable")
    placed = placed_spans(spans.join(asked.select("qid"), "qid", "left_semi"), docs)
    pieces = placed.where("problem is null").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("span_ix", "text"))).alias("p"))
    said = asked.join(pieces, "qid").select("qid", nfc(F.col("question")).alias("question"), nfc(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("text"))
    sets = said.select("qid", F.array_distinct(tokens(F.col("question"))).alias("a"), F.array_distinct(tokens(F.col("text"))).alias("b"))
    scores = sets.select("qid", jaccard(F.col("a"), F.col("b")).alias("score")).withColumn("leaks", F.col("score") > most)
    bad = placed.where("problem is not null").select("qid", F.concat(F.lit("span "), F.col("span_ix").cast("string"), F.lit(": "), "problem").alias("reason"))
    none = asked.join(pieces.select("qid"), "qid", "left_anti").select("qid", F.lit("no usable span").alias("reason"))
    return scores.orderBy(F.desc("score"), "qid"), bad.unionByName(none)
