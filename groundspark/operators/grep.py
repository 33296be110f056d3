"""Search for texts inside texts: an index of grams finds the documents, which are then searched; hits have offsets in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.answers import citation_label, short_label
from groundspark.functions.text import excerpt, folded, literal_pattern, lowered, source_offset, token_estimate
from groundspark.operators.intervals import locate
from groundspark.sources.tables import materialized

#: The longest grams that are indexed; shorter ones are too, for needles that are no longer.
Q = 3


def folded_documents(docs: DataFrame, accents: bool = False) -> DataFrame:
    """(doc_id, body, folded, at, by) of docs (doc_id, body), written once; null bodies are empty."""
    body = F.coalesce("body", F.lit(""))
    rows = docs.select("doc_id", body.alias("body"), (lowered if accents else folded)(body).alias("f"))
    return materialized(rows.select("doc_id", "body", F.col("f.text").alias("folded"), "f.at", "f.by"))


def _grams(rows: DataFrame, text: str) -> DataFrame:
    """rows with _grams: the distinct runs of Q characters of a text, and the shorter ones that it ends with."""
    cut = rows.withColumn("_c", F.split(text, ""))
    run = F.transform("_c", lambda c, i: F.concat(c, *(F.coalesce(F.get("_c", i + k), F.lit("")) for k in range(1, Q))))
    return cut.withColumn("_grams", F.array_distinct(run)).drop("_c")


def gram_index(documents: DataFrame) -> DataFrame:
    """(gram, doc_id) of folded documents: the distinct runs of one to Q characters of each. Can be kept beside the documents."""
    cut = lambda n: F.transform("_grams", lambda g: F.substring(g, 1, n))
    shorter = [cut(n) for n in range(1, Q)]
    rows = _grams(documents.where("folded != ''").select("doc_id", "folded"), "folded")
    return rows.select("doc_id", F.explode_outer(F.array_distinct(F.concat("_grams", *shorter))).alias("gram"))


def candidates(needles: DataFrame, index: DataFrame) -> DataFrame:
    """(needle_id, needle, doc_id): documents that hold the rarest gram of each needle (needle_id, needle; folded).

    Only postings of the needles' grams are kept, and written once. A needle that is a gram or shorter is its own.
    """
    rows = _grams(needles.where("needle != ''"), "needle")
    whole = F.when(F.length("needle") <= Q, F.array("needle")).otherwise(F.filter("_grams", lambda g: F.length(g) == Q))
    wanted = rows.select("needle_id", "needle", F.explode_outer(whole).alias("gram")).where("gram is not null")
    postings = materialized(index.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = wanted.join(counts, "gram", "left").groupBy("needle_id", "needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("m"))
    return rarest.where("m.df > 0").select("needle_id", "needle", F.col("m.gram").alias("gram")).join(postings, "gram").drop("gram")


def grep(needles: DataFrame, docs: DataFrame, accents: bool = False, width: int = 300, marks: tuple[str, str] = ("»", "«"), index: DataFrame | None = None, overlapping: bool = True) -> DataFrame:
    """(needle_id, doc_id, s, e, excerpt): every occurrence of each needle (needle_id, needle) in docs (doc_id, body), overlapping ones too.

    Without overlapping, of those that overlap the ones that a search from the left takes, each beginning where the one before has ended.

    Case never counts, accents and other marks only with `accents`. s and e are offsets in the body, also where folding
    drops or adds characters. Needles that fold to nothing have no hits. docs may be `folded_documents` already, with
    their `gram_index`; both are made here otherwise. Only documents that hold a needle's rarest gram are searched, and
    bodies are joined to hits by doc_id, so no needle meets all texts.
    """
    documents = docs if "folded" in docs.columns else folded_documents(docs, accents)
    sought = needles.select("needle_id", (lowered if accents else folded)(F.col("needle")).getField("text").alias("needle"))
    pairs = candidates(sought, index if index is not None else gram_index(documents))
    found = pairs.join(documents.select("doc_id", "folded"), "doc_id").where(F.contains("folded", F.col("needle")))
    pattern = literal_pattern(F.col("needle"))
    pattern = F.concat(F.lit("(?="), pattern, F.lit(")")) if overlapping else pattern  # pieces hold the needle, or lie between needles
    at_once, skipped = (F.startswith("folded", "needle"), 0) if overlapping else (F.lit(False), F.col("i") * F.col("n") - F.col("n"))
    cut = found.select("needle_id", "doc_id", F.length("needle").alias("n"), at_once.alias("at_once"), F.posexplode_outer(F.split("folded", pattern, -1)).alias("i", "piece"))
    sizes = cut.select("needle_id", "doc_id", "n", "at_once", "i", F.length("piece").alias("size"))
    before = Window.partitionBy("needle_id", "doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    hits = sizes.withColumn("p", (F.coalesce(F.sum("size").over(before), F.lit(0)) + skipped).cast("int")).where((F.col("i") > 0) | F.col("at_once"))
    placed = hits.join(documents.select("doc_id", "body", "at", "by"), "doc_id")
    place = lambda p: source_offset(F.col("at"), F.col("by"), p).cast("int")
    rows = placed.select("needle_id", "doc_id", place(F.col("p")).alias("s"), (place(F.col("p") + F.col("n") - 1) + 1).alias("e"), "body")
    return rows.select("needle_id", "doc_id", "s", "e", excerpt(F.col("body"), F.col("s"), F.col("e") - F.col("s"), width, marks).alias("excerpt"))


def hits_in_clauses(hits: DataFrame, clauses: DataFrame) -> DataFrame:
    """hits (..., doc_id, s, e) with article_no, clause_no, clause_s, clause_e of the clause (doc_id, article_no, clause_no, s, e) where each begins; null between clauses."""
    marked = hits.withColumns({"pos": F.col("s"), "hit_s": F.col("s"), "hit_e": F.col("e")}).drop("s", "e")
    spans = clauses.select("doc_id", "article_no", "clause_no", "s", "e")
    return locate(marked, spans).drop("pos").withColumnsRenamed({"s": "clause_s", "e": "clause_e", "hit_s": "s", "hit_e": "e"})


def gold_fragment(hits: DataFrame, qid: str) -> DataFrame:
    """One row, fragment: a question to fill in, as JSON, whose gold spans are the clauses of hits_in_clauses, each once, by document and place."""
    spans = hits.where("clause_s is not null").select("doc_id", F.col("clause_s").alias("char_start"), F.col("clause_e").alias("char_end")).distinct()
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "char_start", "char_end")))
    todo = lambda text, name: F.lit(text).alias(name)
    return spans.agg(listed.alias("s")).select(F.to_json(F.struct(todo(qid, "qid"), todo("TODO", "question"), todo("factoid_1hop", "type"), F.lit(True).alias("answerable"), F.col("s").alias("gold_spans"), todo("TODO", "gold_answer"))).alias("fragment"))


def article_view(articles: DataFrame, clauses: DataFrame, bodies: DataFrame, titles: DataFrame | None, doc_id: object, article_no: int) -> DataFrame:
    """The clauses of one article in order: label, citation (with titles: doc_id, title), s, e, n_tokens, text; ValueError names what there is instead.

    Each row also has the article's title, chapter, and hull (article_s, article_e).
    """
    own = articles.where(F.col("doc_id") == doc_id)
    numbers = [r["article_no"] for r in own.select("article_no", "article_seq").orderBy("article_seq").collect()]  # of one document
    if article_no not in numbers:
        known = ", ".join(map(str, numbers)) or "nothing; documents: " + ", ".join(sorted(str(r["doc_id"]) for r in articles.select("doc_id").distinct().limit(100).collect()))
        raise ValueError(f"{doc_id} has no article {article_no}; it has {known}")
    first = own.where(F.col("article_no") == article_no).orderBy("article_seq").limit(1).select("doc_id", "article_seq", "title", "chapter")
    each = clauses.join(first, ["doc_id", "article_seq"]).join(bodies, "doc_id")
    whole = Window.partitionBy("doc_id")
    lead = (F.col("clause_no") == 0) & (F.max("clause_no").over(whole) > 0)
    text = F.substring("body", F.col("s") + 1, F.col("e") - F.col("s"))
    label = short_label(F.col("article_no"), F.col("clause_no").cast("string"), lead)
    rows = each.select("doc_id", "article_no", F.col("title").alias("article_title"), "chapter", F.min("s").over(whole).alias("article_s"), F.max("e").over(whole).alias("article_e"), "clause_no", lead.alias("lead"), label.alias("label"), "s", "e", token_estimate(text).alias("n_tokens"), text.alias("text"))
    if titles is not None:
        rows = rows.join(titles.select("doc_id", F.col("title").alias("_t")), "doc_id", "left").withColumn("citation", citation_label(F.col("_t"), F.col("article_no"), F.col("clause_no").cast("string"), F.col("lead"))).drop("_t")
    return rows.drop("lead").orderBy("s")
