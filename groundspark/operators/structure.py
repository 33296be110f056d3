"""Structure of statutes: lines with offsets, headings, clauses, noise, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.text import strip

#: Fixed: how statutes mark their parts, tested on a stripped line.
CHAPTER, SECTION = r"^Chương\s+([IVXLCDM]+|\d+)\s*$", r"^Mục\s+(\d+)\s*$"
ARTICLE, CLAUSE, POINT = r"^Điều\s+(\d+)\.\s*(.*)$", r"^(\d+)\.\s", r"^[a-zđ]\)\s"
TAIL = r"(?U)^(Nơi nhận|PHỤ LỤC|Phụ lục|Biểu mẫu)\b|^_{5,}"
#: Fixed: raw text is told by how a line begins, as titles can stand on the same line.
RAW_HEADINGS = r"^Chương\s+[IVXLCDM]+|^Mục\s+\d+|^Điều\s+(\d+)\."
RAW_START = r"^(Chương\s+[IVXLCDM]+|Điều\s+1\.)"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, line, s, e): lines of docs (doc_id, body), with the offset of the first and after the last character."""
    each = docs.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("ln", "line"))
    before = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("s", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    return each.withColumn("e", F.col("s") + F.length(F.rtrim("line")))


def kind(line: Column) -> Column:
    """chapter, section, article, clause, point or text; references inside a line match nothing."""
    text, out = strip(line), F
    for name, pattern in (("chapter", CHAPTER), ("section", SECTION), ("article", ARTICLE), ("clause", CLAUSE), ("point", POINT)):
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("text")


def with_headings(numbered: DataFrame, heading: Column, name: str, reset: str | None = None) -> DataFrame:
    """Adds the latest heading at or before each line (as-of); a new value of `reset` starts afresh."""
    keys = ["doc_id", reset] if reset else ["doc_id"]
    order = Window.partitionBy(*keys).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn(name, F.last(heading, ignorenulls=True).over(order))


def articles(numbered: DataFrame) -> DataFrame:
    """(doc_id, article_seq, article_no, title, chapter, section, s, e, header_s, header_e) from lines.

    An article ends at the next boundary. A chapter or section is labelled with the line after it unless that one is
    structural too. header_s is where the headings start that come just before the article (its chapter's, else its
    section's, else its own line), header_e the end of its own line.
    """
    text, order = strip(F.col("line")), Window.partitionBy("doc_id").orderBy("ln")
    typed = numbered.withColumn("kind", kind(F.col("line"))).where(text != "")
    titled = F.when(F.lead("kind").over(order) == "text", F.concat(text, F.lit(". "), F.lead(text).over(order))).otherwise(text)
    typed = typed.withColumn("_label", titled).withColumn("_chapter_s", F.when(F.col("kind") == "chapter", F.col("s")))
    typed = with_headings(typed, F.when(F.col("kind") == "chapter", F.col("_label")), "chapter")
    typed = with_headings(typed, F.col("_chapter_s"), "_chapter_at")  # chapters of one label stay apart
    typed = with_headings(typed, F.when(F.col("kind") == "section", F.col("_label")), "section", "_chapter_at")
    edges = typed.where(F.col("kind").isin("chapter", "section", "article")).withColumn("next", F.lead("s").over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_article", F.count(F.when(F.col("kind") == "article", 1)).over(before))
    since = Window.partitionBy("doc_id", "_article").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    above = [F.last(F.when(F.col("kind") == of, F.col("s")), ignorenulls=True).over(since) for of in ("chapter", "section")]
    edges = edges.withColumn("header_s", F.coalesce(*above, F.col("s")))
    end = typed.groupBy("doc_id").agg(F.max("e").alias("last"))
    found = edges.where("kind = 'article'").join(end, "doc_id")
    return found.select(
        "doc_id", F.row_number().over(order).alias("article_seq"), F.regexp_extract(text, ARTICLE, 1).cast("int").alias("article_no"),
        strip(F.regexp_extract(text, ARTICLE, 2)).alias("title"), "chapter", "section", "s", F.coalesce("next", "last").alias("e"),
        "header_s", (F.col("s") + F.length("line")).alias("header_e"),
    )


def accepted_clauses(candidates: Column) -> Column:
    """Of numbered line starts (array of struct n, s) those that count on by one from 1; the others are plain text."""
    start = F.struct(F.lit(1).alias("want"), F.filter(candidates, lambda c: F.lit(False)).alias("got"))

    def take(state: Column, c: Column) -> Column:
        grown = F.struct((state["want"] + 1).alias("want"), F.concat(state["got"], F.array(c)).alias("got"))
        return F.when(c["n"] == state["want"], grown).otherwise(state)

    return F.aggregate(candidates, start, take, lambda s: s["got"])


def clauses(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, article_no, clause_no, s, e) of articles; clause 0 is what comes before clause 1, or an undivided article.

    A clause ends after its last character that isn't blank.
    """
    inside = numbered.join(found.select("doc_id", "article_seq", "article_no", F.col("s").alias("_s"), F.col("e").alias("_e")), "doc_id")
    inside = inside.where((F.col("s") > F.col("_s")) & (F.col("s") < F.col("_e")) & (strip(F.col("line")) != ""))
    number = F.regexp_extract(strip(F.col("line")), CLAUSE, 1).try_cast("int")
    inside = inside.withColumn("before", F.lag("e").over(Window.partitionBy("doc_id", "article_seq").orderBy("ln")))
    marks = F.filter(F.array_sort(F.collect_list(F.struct("s", number.alias("n"), "before"))), lambda c: c["n"].isNotNull())
    each = inside.groupBy("doc_id", "article_seq", "article_no").agg(F.min("s").alias("first"), F.max("e").alias("last"), marks.alias("marks"))
    got = accepted_clauses(F.col("marks"))
    lead = F.when((F.size("got") == 0) | (F.get("got", F.lit(0))["s"] > F.col("first")), F.array(F.struct(F.col("first").alias("s"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("before"))))
    each = each.withColumn("got", got).withColumn("all", F.concat(F.coalesce(lead, F.slice("got", F.lit(1), F.lit(0))), "got"))
    each = each.select("doc_id", "article_seq", "article_no", "last", F.posexplode("all").alias("i", "c"))
    order = Window.partitionBy("doc_id", "article_seq").orderBy("i")
    return each.select("doc_id", "article_seq", "article_no", F.col("c.n").alias("clause_no"), F.col("c.s").alias("s"), F.coalesce(F.lead("c.before").over(order), "last").alias("e"))


def drop_noise(numbered: DataFrame, often: int = 3) -> DataFrame:
    """Lines without page numbers (digits alone) and without lines that a document repeats more than `often` times."""
    text = strip(F.col("line"))
    times = F.count("*").over(Window.partitionBy("doc_id", text))
    return numbered.withColumn("_n", times).where((text == "") | (~text.rlike("^\\d+$") & (F.col("_n") <= often))).drop("_n")


def scope(numbered: DataFrame) -> DataFrame:
    """Lines from the first chapter or article 1 up to the first tail mark after it."""
    text = strip(F.col("line"))
    whole = Window.partitionBy("doc_id")
    first = F.min(F.when(text.rlike(RAW_START), F.col("ln"))).over(whole)
    cut = numbered.withColumn("_a", first).where(F.col("_a").isNull() | (F.col("ln") >= F.col("_a")))
    tail = F.min(F.when(strip(F.col("line")).rlike(TAIL), F.col("ln"))).over(whole)
    return cut.withColumn("_z", tail).where(F.col("_z").isNull() | (F.col("ln") < F.col("_z"))).drop("_a", "_z")
