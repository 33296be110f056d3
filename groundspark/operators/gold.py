"""Gold questions: validation against documents and articles, audits, first question of each type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.intervals import interval_union


def gold_problems(questions: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, problem) for questions (qid, answerable), spans (qid, doc_id, s, e) and docs (doc_id, body)."""
    placed = spans.join(docs.select("doc_id", F.length("body").alias("_n")), "doc_id", "left")
    why = F.when(F.col("_n").isNull(), "unknown document").when(~((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("_n"))), "span outside its document")
    wrong = placed.select("qid", why.alias("problem")).where("problem is not null")
    held = questions.join(spans.select("qid", F.lit(True).alias("_has")).distinct(), "qid", "left")
    odd = held.where(F.col("answerable") != F.coalesce("_has", F.lit(False))).select("qid", F.when(F.col("answerable"), "answerable without a span").otherwise("a span though not answerable").alias("problem"))
    return wrong.unionByName(odd)


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where("answerable")


def question(questions: DataFrame, qid: str) -> DataFrame:
    """The question of that id; raises ValueError without one."""
    found = questions.where(F.col("qid") == qid)
    if found.isEmpty():
        raise ValueError(f"no question {qid}")
    return found


def spans_in_articles(spans: DataFrame, articles: DataFrame) -> DataFrame:
    """spans (qid, doc_id, s, e) with article_no of the first article (doc_id, article_seq, article_no, s, e) whose hull holds the whole span, else null."""
    hull = articles.select("doc_id", "article_seq", F.col("article_no").alias("_no"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    joined = spans.join(hull, "doc_id", "left")
    inside = (F.col("_s") <= F.col("s")) & (F.col("e") <= F.col("_e"))
    return joined.groupBy(*spans.columns).agg(F.min_by(F.when(inside, F.col("_no")), F.when(inside, F.col("article_seq"))).alias("article_no"))


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Spans (qid, span_ix, doc_id, s, e), each once, numbered afresh in their first order."""
    once = spans.groupBy("qid", "doc_id", "s", "e").agg(F.min("span_ix").alias("_first"))
    return once.withColumn("span_ix", F.row_number().over(Window.partitionBy("qid").orderBy("_first")) - 1).drop("_first")


def article_audit(wanted: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, missing, extra): wanted article numbers that weren't parsed, and the other way round; wanted and parsed are (doc_id, article_no)."""
    w = wanted.groupBy("doc_id").agg(F.collect_set("article_no").alias("_w"))
    p = parsed.groupBy("doc_id").agg(F.collect_set("article_no").alias("_p"))
    none = F.array().cast(parsed.select(F.array("article_no").alias("a")).schema["a"].dataType)
    w_, p_ = F.coalesce("_w", none), F.coalesce("_p", none)
    return w.join(p, "doc_id", "full").select("doc_id", F.array_sort(F.array_except(w_, p_)).alias("missing"), F.array_sort(F.array_except(p_, w_)).alias("extra"))


def structure_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, n_chapters, n_sections, n_articles, n_clauses, gaps) of lines (doc_id, ln, kind, article_no).

    gaps are pairs (a, b) of article numbers next to each other where b doesn't follow a, in order.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind)
    numbers = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "article", F.struct("ln", "article_no")))), lambda x: x["article_no"])
    found = lines.groupBy("doc_id").agg(n("chapter").alias("n_chapters"), n("section").alias("n_sections"), n("article").alias("n_articles"), n("clause").alias("n_clauses"), numbers.alias("_a"))
    m = F.size("_a")
    pairs = F.zip_with(F.slice("_a", F.lit(1), m - 1), F.slice("_a", F.lit(2), m - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    odd = F.filter(pairs, lambda p: p["b"] != p["a"] + 1)
    return found.withColumn("gaps", F.when(m > 1, odd).otherwise(F.slice(F.transform("_a", lambda a: F.struct(a.alias("a"), a.alias("b"))), 1, 0))).drop("_a")


def corpus_audit(bodies: DataFrame, articles: DataFrame, chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_articles, n_chunks, median_tokens, coverage, missing, extra), a row for each of bodies (doc_id, body).

    coverage is the share of the body that the chunks (doc_id, s, e, n_tokens) cover together, 0 for an empty body; the
    median is exact, 0 without chunks. missing and extra compare the articles (doc_id, article_no) with the wanted ones,
    where a document has any. Bodies are reduced to their lengths before anything is joined.
    """
    covered = interval_union(chunks.select("doc_id", "s", "e"), ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("e") - F.col("s")).alias("_covered"))
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.median("n_tokens").alias("median_tokens"))
    counted = articles.groupBy("doc_id").agg(F.count("*").alias("n_articles"))
    rows = bodies.select("doc_id", F.length(F.coalesce("body", F.lit(""))).alias("_n"))
    for part in (counted, sizes, covered):
        rows = rows.join(part, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    coverage = F.when(F.col("_n") > 0, F.coalesce("_covered", F.lit(0)) / F.col("_n")).otherwise(0.0)
    kind = articles.schema["article_no"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    if wanted is None:
        rows = rows.withColumns({"missing": none, "extra": none})
    else:
        listed = wanted.select("doc_id").distinct()
        rows = rows.join(article_audit(wanted, articles.join(listed, "doc_id", "left_semi")), "doc_id", "left")
    return rows.select("doc_id", zero("n_articles"), zero("n_chunks"), F.coalesce("median_tokens", F.lit(0.0)).alias("median_tokens"), coverage.alias("coverage"), F.coalesce("missing", none).alias("missing"), F.coalesce("extra", none).alias("extra"))


def first_of_each_type(questions: DataFrame, order: str = "qid") -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("type").orderBy(order))
    return questions.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def leakage_order(scores: DataFrame) -> DataFrame:
    """Leakage rows (qid, score), highest score first; equal scores by qid."""
    return scores.orderBy(F.desc("score"), "qid")
