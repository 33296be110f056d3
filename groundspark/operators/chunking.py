"""Clauses to chunks: greedy packing as a fold, sentence splitting with overlap for oversize clauses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.answers import chunk_id, clause_range
from groundspark.functions.text import strip

LEAST, MOST, OVERLAP = 120, 600, 0.15
#: Fixed: what ends a sentence.
_SENTENCE = re.compile("[.!?]+[\"'”’)\\]]*\\s+")
#: Fixed: abbreviations after which a full stop ends no sentence, in lower case.
ABBREVIATIONS = (
    "tp.", "tt.", "ts.", "ths.", "gs.", "pgs.", "nđ.", "qđ.", "tw.",
    "đ.", "tr.", "vd.", "v.v.", "stt.", "kt.", "tl.", "kg.", "khcn.",
)
_LAST = re.compile(r"\S+$")


def tokens_between(s: Column, e: Column) -> Column:
    return F.greatest(F.lit(1), F.bround((e - s) / F.lit(3.5)).cast("int"))


def packed(clauses: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Groups (array of struct s, e, first, last, split, lead) of an article's clauses (array of struct n, s, e, in order).

    Clauses over `most` tokens and lead-ins stand alone. Others gather until `least` tokens, and never beyond `most`. A
    remainder under `least` joins the group before it if that one is neither split nor a lead-in and has room.
    """
    kind = "struct<s:int,e:int,first:int,last:int,split:boolean,lead:boolean>"
    group = lambda c: F.struct(
        c["s"].cast("int").alias("s"), c["e"].cast("int").alias("e"), c["n"].alias("first"), c["n"].alias("last"),
        (tokens_between(c["s"], c["e"]) > most).alias("split"), (c["n"] == 0).alias("lead"),
    ).cast(kind)
    size = lambda g: tokens_between(g["s"], g["e"])
    alone = lambda g: g["split"] | g["lead"]
    merged = lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e"), a["first"].alias("first"), b["last"].alias("last"), F.lit(False).alias("split"), F.lit(False).alias("lead")).cast(kind)
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def add(done: Column, c: Column) -> Column:
        g, n = group(c), F.size(done)
        last = F.get(done, n - 1)
        fits = (n > 0) & ~alone(last) & ~alone(g) & (size(last) < least) & (tokens_between(last["s"], g["e"]) <= most)
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, F.lit(1), n - 1), F.array(merged(last, g)))).otherwise(F.concat(done, F.array(g)))

    def finish(done: Column) -> Column:
        n = F.size(done)
        last, prior = F.get(done, n - 1), F.get(done, n - 2)
        short = (n > 1) & ~alone(last) & (size(last) < least) & ~alone(prior) & (tokens_between(prior["s"], last["e"]) <= most)
        return F.when(F.coalesce(short, F.lit(False)), F.concat(F.slice(done, F.lit(1), n - 2), F.array(merged(prior, last)))).otherwise(done)

    return F.aggregate(clauses, empty, add, finish)


def ends_no_sentence(before: str) -> bool:
    """Whether the mark after `before` follows nothing, an abbreviation, a number or a single capital."""
    word = _LAST.search(before[-200:])
    stem = word[0] if word else ""
    return not stem or f"{stem.lower()}." in ABBREVIATIONS or stem.isdigit() or (len(stem) == 1 and stem.isupper())


def sentences(text: str) -> list[tuple[int, int]]:
    """Gap-free spans; blanks after a sentence belong to it."""
    cuts = [m.end() for m in _SENTENCE.finditer(text) if not ends_no_sentence(text[max(0, m.start() - 200) : m.start()])]
    edges = [0, *cuts, *([len(text)] if not cuts or cuts[-1] < len(text) else [])]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def overlapping_parts(text: str, most: int = MOST, share: float = OVERLAP) -> list[tuple[int, int]]:
    """Runs of whole sentences up to `most` tokens; each begins so far back that `share` of `most` is in common."""
    cost = lambda a, b: max(1, round((b - a) / 3.5))
    spans, out, i = sentences(text), [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and cost(spans[i][0], spans[j][1]) <= most:
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        if j == len(spans):
            break
        k = j
        while k > i + 1 and cost(spans[k][0], spans[j - 1][1]) < share * most:
            k -= 1
        i = k
    return out


#: The same mark as a Java pattern: what a text up to and with it is, and what comes before it.
_MARK = "[.!?]+[\"'”’)\\]]*\\s+"
_SPAN = "struct<s:int,e:int>"


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def _ends_sentence(piece: Column, before: Column) -> Column:
    """Whether a piece that a mark ends is the end of a sentence; see `ends_no_sentence`. A line feed right before the mark hides no word."""
    stem = F.regexp_extract(F.concat(before, F.regexp_extract(piece, f"(?sU)^(.*?){_MARK}\\z", 1)), "(?dU)(\\S+)$", 1)
    number, capital = stem.rlike("^[\\p{Nd}²³¹⁰-⁹₀-₉]+\\z"), stem.rlike("^\\p{Lu}\\z")
    return piece.rlike(f"(?sU){_MARK}\\z") & (stem != "") & ~F.concat(F.lower(stem), F.lit(".")).isin(*ABBREVIATIONS) & ~number & ~capital


def with_sentences(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the gap-free sentence spans (array of struct s, e) of a column; blanks after a sentence belong to it; null for null."""
    pieces = rows.withColumn("_raw", F.regexp_extract_all(text, F.lit(f"(?sU).*?{_MARK}|.+\\z"), F.lit(0)))
    last = F.size("_raw") - 1
    sized = pieces.withColumn("_pieces", F.transform("_raw", lambda p, i: F.struct(F.length(p).alias("n"), (_ends_sentence(p, F.coalesce(F.get("_raw", i - 1), F.lit(""))) | (i == last)).alias("ends"))))
    state = f"struct<start:int,at:int,out:array<{_SPAN}>>"
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), _none().alias("out")).cast(state)

    def add(so_far: Column, p: Column) -> Column:
        at = so_far["at"] + p["n"]
        done = F.concat(so_far["out"], F.array(F.struct(so_far["start"].alias("s"), at.alias("e")).cast(_SPAN)))
        return F.when(p["ends"], F.struct(at.alias("start"), at.alias("at"), done.alias("out")).cast(state)).otherwise(F.struct(so_far["start"].alias("start"), at.alias("at"), so_far["out"].alias("out")).cast(state))

    return sized.withColumn(name, F.aggregate("_pieces", start, add, lambda x: x["out"])).drop("_raw", "_pieces")


def packed_sentences(spans: str, most: int = MOST, share: float = OVERLAP) -> Column:
    """Runs of whole sentences (a column of spans) up to `most` tokens; each begins so far back that `share` of `most` is in common.

    A fold over the sentences: one that doesn't fit closes the run, and the next run begins as far back as it should;
    if the sentence still doesn't fit, that run is closed as well, and so on up to the sentence itself.
    """
    span = lambda k: F.get(spans, k)
    cost = lambda i, j: tokens_between(span(i)["s"], span(j)["e"])
    state = f"struct<i:int,out:array<{_SPAN}>>"
    made = lambda i, out: F.struct(i.alias("i"), out.alias("out")).cast(state)
    run = lambda i, j: F.struct(span(i)["s"].alias("s"), span(j)["e"].alias("e")).cast(_SPAN)

    def add(so_far: Column, j: Column) -> Column:
        def close(x: Column, _: Column) -> Column:
            back = F.array_max(F.filter(F.sequence(x["i"] + 1, F.greatest(j - 1, x["i"] + 1)), lambda k: (k < j) & (cost(k, j - 1) >= share * most)))
            full = (j > x["i"]) & (cost(x["i"], j) > most)
            return F.when(full, made(F.coalesce(back, x["i"] + 1), F.concat(x["out"], F.array(run(x["i"], j - 1))))).otherwise(x)

        return F.aggregate(F.sequence(so_far["i"], F.greatest(j, so_far["i"])), so_far, close)

    places = F.sequence(F.lit(0), F.size(spans) - 1)
    whole = F.aggregate(places, made(F.lit(0), _none()), add, lambda x: F.concat(x["out"], F.array(run(x["i"], F.size(spans) - 1))))
    return F.when(F.size(spans) > 0, whole).otherwise(_none())


def with_parts(rows: DataFrame, text: str, name: str, most: int = MOST, share: float = OVERLAP) -> DataFrame:
    """rows with the parts (array of struct s, e) of a text that is too long for a chunk; none for null and empty texts."""
    return with_sentences(rows, text, "_sentences").withColumn(name, packed_sentences("_sentences", most, share)).drop("_sentences")


def chunks(clauses: DataFrame, bodies: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunks of articles, from their clauses and bodies (doc_id, body).

    Columns: chunk_id, doc_id, article_no, title, chapter, section, clause_range, part, s, e, text, n_tokens, is_lead_in.
    The first chunk of an article starts with the headings before it; an article without clauses is one chunk of those.
    """
    per = clauses.groupBy("doc_id", "article_seq").agg(F.array_sort(F.collect_list(F.struct("s", F.col("clause_no").alias("n"), "e"))).alias("c"))
    headers = F.array(F.struct(
        F.col("header_s").cast("int").alias("s"), F.col("header_e").cast("int").alias("e"), F.lit(0).alias("first"), F.lit(0).alias("last"),
        F.lit(False).alias("split"), F.lit(False).alias("lead"),
    ))
    of = articles.select("doc_id", "article_seq", "article_no", "title", "chapter", "section", "header_s", "header_e").join(per, ["doc_id", "article_seq"], "left")
    of = of.withColumn("divided", F.coalesce(F.exists("c", lambda c: c["n"] > 0), F.lit(False)))
    groups = of.select("*", F.posexplode_outer(F.when(F.col("c").isNull(), headers).otherwise(packed(F.col("c")))).alias("group", "g")).where("g is not null").drop("c").join(bodies, "doc_id")
    text = F.substring(F.col("body"), F.col("g.s") + 1, F.col("g.e") - F.col("g.s"))
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("g.e") - F.col("g.s")).alias("e")))
    parts = with_parts(groups.withColumn("_long", F.when(F.col("g.split"), text)), "_long", "_cut")
    parts = parts.withColumn("parts", F.when(F.col("g.split"), F.col("_cut")).otherwise(whole)).drop("_long", "_cut")
    each = parts.select("*", F.posexplode_outer("parts").alias("part", "p")).where("p is not null")  # outer, as Spark else filters by all of the above once more
    each = each.withColumn("s", F.when((F.col("group") == 0) & (F.col("part") == 0), F.col("header_s").cast("int")).otherwise(F.col("g.s") + F.col("p.s")))
    each = each.withColumn("e", F.col("g.s") + F.col("p.e")).withColumn("clause_range", clause_range(F.col("g.first"), F.col("g.last")))
    return each.select(
        chunk_id(F.col("doc_id"), F.col("article_no"), F.col("clause_range"), F.col("part")).alias("chunk_id"), "doc_id", "article_no", "title", "chapter", "section",
        "clause_range", "part", "s", "e", F.substring(F.col("body"), F.col("s") + 1, F.col("e") - F.col("s")).alias("text"),
        tokens_between(F.col("s"), F.col("e")).alias("n_tokens"), ((F.col("g.first") == 0) & F.col("divided")).alias("is_lead_in"),
    )


def coverage_holes(chunked: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, s, e) of stretches with text that no chunk covers."""
    from pyspark.sql import Window

    from groundspark.operators.intervals import interval_union

    ends = bodies.select("doc_id", F.lit(0).alias("s"), F.lit(0).alias("e")).unionByName(bodies.select("doc_id", F.length("body").alias("s"), F.length("body").alias("e")))
    islands = interval_union(chunked.select("doc_id", "s", "e"), ["doc_id"]).unionByName(ends)
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    gaps = islands.select("doc_id", F.col("e").alias("s"), F.lead("s").over(order).alias("e")).where("s < e").join(bodies, "doc_id")
    return gaps.where(F.substring(F.col("body"), F.col("s") + 1, F.col("e") - F.col("s")).rlike("\\S")).select("doc_id", "s", "e")


def _raised(when: Column, said: Column, keep: Column) -> Column:
    return F.when(when, F.raise_error(said).cast("string")).otherwise(keep.cast("string"))


def offset_problems(clauses: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, article_no, clause_no, s, e, problem) of clauses that don't cut what they should from their body.

    A clause lies in its body, holds text, begins and ends at its first and last character that isn't blank, and begins
    with its number where it has one.
    """
    text = F.substring("body", F.col("s") + 1, F.col("e") - F.col("s"))
    problem = (
        F.when(F.col("body").isNull(), "unknown document")
        .when(~((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.length("body"))), "outside of the body")
        .when(strip(text) != text, "blank at an end")
        .when((F.col("clause_no") > 0) & ~F.startswith(text, F.concat(F.col("clause_no").cast("string"), F.lit("."))), "not at its number")
    )
    return clauses.join(bodies, "doc_id", "left").select("doc_id", "article_no", "clause_no", "s", "e", problem.alias("problem")).where("problem is not null")


def checked_clauses(clauses: DataFrame, bodies: DataFrame) -> DataFrame:
    """The clauses, where any that `offset_problems` names raises when rows are read."""
    odd = offset_problems(clauses, bodies).groupBy("doc_id").agg(F.min(F.struct("article_no", "clause_no", "s", "e", "problem")).alias("_odd"))
    said = F.concat(F.lit("clause "), F.to_json("_odd"), F.lit(" of "), F.col("doc_id").cast("string"))
    kind = clauses.schema["doc_id"].dataType
    return clauses.join(odd, "doc_id", "left").withColumn("doc_id", _raised(F.col("_odd").isNotNull(), said, F.col("doc_id")).cast(kind)).select(*clauses.columns)


def checked_chunks(chunked: DataFrame, bodies: DataFrame) -> DataFrame:
    """The chunks, where text of a document that no chunk covers raises when rows are read, with its place."""
    holes = coverage_holes(chunked, bodies).groupBy("doc_id").agg(F.min(F.struct("s", "e")).alias("_hole"))
    said = F.concat(F.lit("no chunk covers "), F.to_json("_hole"), F.lit(" of "), F.col("doc_id").cast("string"))
    kind = chunked.schema["doc_id"].dataType
    return chunked.join(holes, "doc_id", "left").withColumn("doc_id", _raised(F.col("_hole").isNotNull(), said, F.col("doc_id")).cast(kind)).select(*chunked.columns)
