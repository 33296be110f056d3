"""Raw statute texts to bodies that can be parsed, article selection, outlines. A document is a row all along: nothing is shuffled.

Columns that a lambda uses are also used outside of it, so that Spark computes them once a row instead of once a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import SPACE, clean_characters, line_feeds, nfc, squeeze_blanks, strip, token_estimate
from groundspark.operators.structure import POINT, RAW_HEADINGS, RAW_START, TAIL

#: Fixed: how lines of raw text begin, tested on a stripped line; what ends a sentence; when an article is too long to be one.
RAW_CHAPTER, RAW_SECTION, RAW_ARTICLE, RAW_CLAUSE = r"(?U)^Chương\s+[IVXLCDM]+", r"(?U)^Mục\s+\d+", r"(?U)^Điều\s+(\d+)\.\s*(.*)$", r"(?U)^(\d+)\.\s"
SENTENCE_END = r"[.;:!?]\z"
REPEATED, LONG_ARTICLE = 3, 2000

_WARNING = "array<struct<kind:string,detail:string>>"


def is_heading(text: Column) -> Column:
    return text.rlike(f"(?U){RAW_HEADINGS}")


def is_structural(text: Column) -> Column:
    return is_heading(text) | text.rlike(RAW_CLAUSE) | text.rlike(f"(?U){POINT}")


def _first(found: Column) -> Column:
    """Where the first true of an array is, from 1; 0 without one."""
    return F.array_position(found, F.lit(True)).cast("int")


def _integers(lines: Column, pattern: str) -> Column:
    return F.transform(F.filter(lines, lambda x: strip(x).rlike(pattern)), lambda x: F.regexp_extract(strip(x), pattern, 1).try_cast("bigint"))


def _warning(kind: str, when: Column, detail: Column) -> Column:
    said = F.array(F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    return F.when(when, said).otherwise(F.array().cast(_WARNING))


def joined_lines(lines: Column) -> Column:
    """struct (text, n): the lines as a text, a line broken inside a sentence put on the one before it, and how many were.

    A line stays on its own if it is blank or structural, or follows a blank line, a heading or the end of a sentence;
    what it follows is the line as joined so far.
    """
    state = "struct<done:string,now:string,n:int>"
    start = F.lit(None).cast(state)

    def add(so_far: Column, line: Column) -> Column:
        text, before = strip(line), strip(F.coalesce(so_far["now"], F.lit("")))
        joins = (text != "") & (before != "") & ~is_structural(text) & ~is_heading(before) & ~before.rlike(SENTENCE_END)
        on = F.struct(so_far["done"].alias("done"), F.concat(F.regexp_replace(so_far["now"], f"{SPACE}+\\z", ""), F.lit(" "), text).alias("now"), (so_far["n"] + 1).alias("n"))
        done = F.when(so_far["done"].isNull(), so_far["now"]).otherwise(F.concat(so_far["done"], F.lit("\n"), so_far["now"]))
        apart = F.struct(done.alias("done"), line.alias("now"), F.coalesce(so_far["n"], F.lit(0)).alias("n"))
        return F.when(joins, on.cast(state)).otherwise(apart.cast(state))

    return F.aggregate(lines, start, add, lambda s: F.struct(F.concat_ws("\n", s["done"], s["now"]).alias("text"), F.coalesce(s["n"], F.lit(0)).alias("n")))


def normalized(docs: DataFrame) -> DataFrame:
    """(doc_id, body, n_lines_joined, n_lines_dropped, n_chapters, n_articles, n_clauses, gaps, warnings) of docs (doc_id, text).

    In order: characters; page numbers and lines that occur more than REPEATED times go; broken lines are joined;
    blanks are squeezed; what comes before the first chapter or article 1 and from the first tail mark on goes; what is
    left is counted. gaps are neighbouring article numbers (a, b) where b doesn't follow a, as they stand, steps back
    and repeats too. warnings (kind, detail): repeated_lines, no_start, cut_tail, no_article, article_gaps. A null text
    counts as empty. The body ends with one line feed.
    """
    rows = docs.select("doc_id", F.split(clean_characters(line_feeds(nfc(F.coalesce("text", F.lit(""))))), "\n", -1).alias("raw"))
    rows = rows.withColumn("_sorted", F.array_sort(F.filter(F.transform("raw", strip), lambda x: x != "")))
    often = F.array_distinct(F.filter("_sorted", lambda x, i: x == F.get("_sorted", i - REPEATED)))
    rows = rows.withColumn("_often", often)
    noise = lambda x: strip(x).rlike(r"(?U)^\d+$") | ((F.size("_often") > 0) & F.array_contains("_often", strip(x)))
    rows = rows.withColumn("_clean", F.filter("raw", lambda x: ~noise(x)))
    rows = rows.withColumn("_joined", joined_lines(F.col("_clean"))).withColumn("_lines", F.split(squeeze_blanks(F.col("_joined.text")), "\n", -1))
    rows = rows.withColumn("_start", _first(F.transform("_lines", lambda x: strip(x).rlike(f"(?U){RAW_START}"))))
    rows = rows.withColumn("_rest", F.slice("_lines", F.greatest(F.col("_start"), F.lit(1)), F.size("_lines")))
    rows = rows.withColumn("_end", _first(F.transform("_rest", lambda x: strip(x).rlike(TAIL))))
    kept = F.when(F.col("_end") > 0, F.slice("_rest", F.lit(1), F.col("_end") - 1)).otherwise(F.col("_rest"))
    rows = rows.withColumn("_text", squeeze_blanks(F.array_join(kept, "\n"))).withColumn("_kept", F.split("_text", "\n", -1))
    numbers = _integers(F.col("_kept"), RAW_ARTICLE)
    rows = rows.withColumn("_numbers", numbers)
    n = F.size("_numbers")
    pairs = F.zip_with(F.slice("_numbers", F.lit(1), n - 1), F.slice("_numbers", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("gaps", F.when(n > 1, F.filter(pairs, lambda p: p["b"] != p["a"] + 1)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")))
    dropped = F.size("raw") - F.size("_clean") + F.greatest(F.col("_start") - 1, F.lit(0)) + F.when(F.col("_end") > 0, F.size("_rest") - F.col("_end") + 1).otherwise(0)
    count = lambda pattern: F.size(F.filter("_kept", lambda x: strip(x).rlike(pattern)))
    steps = F.array_join(F.transform(F.slice("gaps", 1, 5), lambda g: F.concat_ws("->", g["a"].cast("string"), g["b"].cast("string"))), ", ")
    warnings = F.concat(
        _warning("repeated_lines", F.size("_often") > 0, F.concat(F.size("_often").cast("string"), F.lit(": "), F.substring(F.array_join(F.slice("_often", 1, 3), ", "), 1, 120))),
        _warning("no_start", F.col("_start") == 0, F.lit("")),
        _warning("cut_tail", F.col("_end") > 0, F.substring(strip(F.get("_rest", F.col("_end") - 1)), 1, 60)),
        _warning("no_article", n == 0, F.lit("")), _warning("article_gaps", F.size("gaps") > 0, steps),
    )
    return rows.select(
        "doc_id", F.concat(strip(F.col("_text")), F.lit("\n")).alias("body"), F.col("_joined.n").alias("n_lines_joined"), dropped.alias("n_lines_dropped"),
        count(RAW_CHAPTER).alias("n_chapters"), n.alias("n_articles"), count(RAW_CLAUSE).alias("n_clauses"), "gaps", warnings.alias("warnings"),
    )


def _units(docs: DataFrame, sections: bool) -> DataFrame:
    """docs (doc_id, body) with _ls, the lines, and _units: (at, head, kind, no, own) of chapters, sections and articles, own being their lines."""
    head = lambda x: strip(x).rlike(f"{RAW_CHAPTER}|{RAW_ARTICLE}" + (f"|{RAW_SECTION}" if sections else ""))
    rows = docs.select("doc_id", F.split(F.coalesce("body", F.lit("")), "\n", -1).alias("_ls"))
    places = F.filter(F.transform("_ls", lambda x, i: F.when(head(x), i + 1)), lambda p: p.isNotNull())
    rows = rows.withColumn("_at", places)

    def unit(at: Column, i: Column) -> Column:
        text = strip(F.get("_ls", at - 1))
        kind = F.when(text.rlike(RAW_CHAPTER), "chapter").when(text.rlike(RAW_ARTICLE), "article").otherwise("section")
        own = F.slice("_ls", at, F.coalesce(F.get("_at", i + 1), F.size("_ls") + 1) - at)
        return F.struct(at.alias("at"), text.alias("head"), kind.alias("kind"), F.regexp_extract(text, RAW_ARTICLE, 1).try_cast("bigint").alias("no"), own.alias("own"))

    return rows.withColumn("_units", F.transform("_at", unit))


def select_articles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, body) of docs with the wanted articles (doc_id, article_no) only, and the headings that they stand under.

    A chapter's or section's heading is its line and the lines after it up to a blank or structural one. It waits until
    an article under it is kept, and goes where none is; other text outside articles goes too. Numbers stay as they are;
    a document without wanted articles gets an empty body.
    """
    lists = wanted.groupBy("doc_id").agg(F.collect_set(F.col("article_no").cast("bigint")).alias("_wanted"))
    rows = _units(docs, sections=True).join(lists, "doc_id", "left")
    state = "struct<chapter:string,section:string,out:string>"

    def block(own: Column) -> Column:
        ends = _first(F.transform(F.slice(own, F.lit(2), F.size(own)), lambda x: (strip(x) == "") | is_structural(strip(x))))
        return F.array_join(F.when(ends > 0, F.slice(own, F.lit(1), ends)).otherwise(own), "\n")

    def with_block(out: Column, text: Column) -> Column:
        return F.when(text.isNull(), out).otherwise(F.concat(out, F.when(out != "", "\n").otherwise(""), text, F.lit("\n\n")))

    def add(so_far: Column, u: Column) -> Column:
        kept = F.concat(with_block(with_block(so_far["out"], so_far["chapter"]), so_far["section"]), F.array_join(u["own"], "\n"), F.lit("\n"))
        made = lambda chapter, section, out: F.struct(chapter.alias("chapter"), section.alias("section"), out.alias("out")).cast(state)
        none = F.lit(None).cast("string")
        return (
            F.when(u["kind"] == "chapter", made(block(u["own"]), none, so_far["out"]))
            .when(u["kind"] == "section", made(so_far["chapter"], block(u["own"]), so_far["out"]))
            .when(u["keep"], made(none, none, kept))
            .otherwise(so_far)
        )

    marked = F.transform("_units", lambda u: F.struct(u["kind"].alias("kind"), u["own"].alias("own"), F.coalesce(F.array_contains("_wanted", u["no"]), F.lit(False)).alias("keep")))
    start = F.struct(F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"), F.lit("").alias("out")).cast(state)
    return rows.select("doc_id", F.concat(strip(F.aggregate(marked, start, add, lambda s: s["out"])), F.lit("\n")).alias("body"))


def outline(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, chapter, article_no, title, n_clauses, n_tokens, warnings), a row for each article of docs (doc_id, body).

    A chapter is labelled with the next line that isn't blank, unless that is structural. An article reaches to the next
    article or chapter. warnings (kind, detail): no_clauses; clause_order, where clauses don't count on from 1; long.
    """
    rows = _units(docs, sections=False)
    following = lambda at: strip(F.get(F.filter(F.slice("_ls", at + 1, F.size("_ls")), lambda x: strip(x) != ""), F.lit(0)))
    label = lambda u: F.when(is_structural(F.coalesce(following(u["at"]), F.lit("1. "))), u["head"]).otherwise(F.concat(u["head"], F.lit(" — "), following(u["at"])))
    chapters = F.transform(F.filter("_units", lambda u: u["kind"] == "chapter"), lambda u: F.struct(u["at"].alias("at"), label(u).alias("label")))
    rows = rows.withColumn("_chapters", chapters)
    above = lambda at: F.when(F.size("_chapters") > 0, F.array_max(F.filter("_chapters", lambda c: c["at"] < at))["label"])
    found = F.transform(
        F.filter("_units", lambda u: u["kind"] == "article"),
        lambda u: F.struct(above(u["at"]).alias("chapter"), u["no"].alias("article_no"), strip(F.regexp_extract(u["head"], RAW_ARTICLE, 2)).alias("title"), F.slice(u["own"], F.lit(2), F.size(u["own"])).alias("own")),
    )
    each = rows.select("doc_id", F.posexplode_outer(found).alias("seq", "a")).where("a is not null").select("doc_id", (F.col("seq") + 1).alias("seq"), "a.*")
    each = each.withColumn("_clauses", _integers(F.col("own"), RAW_CLAUSE)).withColumn("n_tokens", token_estimate(F.array_join("own", "\n")))
    n = F.size("_clauses")
    numbered = F.concat(F.lit("["), F.array_join(F.col("_clauses").cast("array<string>"), ", "), F.lit("]"))
    in_order = F.when(n > 0, F.col("_clauses") == F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(True)
    warnings = F.concat(_warning("no_clauses", n == 0, F.lit("")), _warning("clause_order", ~in_order, numbered), _warning("long", F.col("n_tokens") > LONG_ARTICLE, F.col("n_tokens").cast("string")))
    return each.select("doc_id", "seq", "chapter", "article_no", "title", n.alias("n_clauses"), "n_tokens", warnings.alias("warnings"))


def outline_text(articles: DataFrame) -> DataFrame:
    """(doc_id, outline): articles of `outline` as lines, a chapter's label above its first one, warnings below theirs."""
    name = F.concat(F.lit("  Điều "), F.col("article_no").cast("string"), F.lit(". "), "title")
    line = F.concat(F.when(F.length(name) < 52, F.rpad(name, 52, " ")).otherwise(name), F.format_string(" (%d khoản, %d token)", "n_clauses", "n_tokens"))
    said = F.transform("warnings", lambda w: F.concat(F.lit(" " * 53 + "! "), w["kind"], F.when(w["detail"] != "", F.concat(F.lit(": "), w["detail"])).otherwise("")))
    row = F.struct("seq", F.coalesce("chapter", F.lit("(no chapter)")).alias("chapter"), F.concat_ws("\n", line, said).alias("text"))
    rows = articles.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    headed = F.transform("rows", lambda r, i: F.concat(F.when((i == 0) | (F.get("rows", i - 1)["chapter"] != r["chapter"]), F.concat(r["chapter"], F.lit("\n"))).otherwise(""), r["text"]))
    return rows.select("doc_id", F.array_join(headed, "\n").alias("outline"))
