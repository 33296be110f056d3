"""Labels, context, drafts, verdicts and answers as column expressions; chunks and claims are arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.functions.json import elements, integer, is_object, json_body, last_of_each, listed, member, text_of, truthy
from groundspark.functions.text import diacritic_ratio, strip

#: Fixed: what labels, problems and feedback say.
LEAD_IN, ARTICLE, CLAUSE = " (đoạn mở đầu)", "Điều ", " Khoản "
WRONG_CITATIONS, UNSUPPORTED = "Lượt trước sai về trích dẫn:", "Lượt trước có mệnh đề không được trích đoạn hỗ trợ:"
MEND = (
    "Sửa hoặc BỎ HẲN những mệnh đề trên. Không thêm mệnh đề mới nếu không có căn cứ trong danh sách trích đoạn. "
    "Nếu sau khi bỏ thì không còn gì để trả lời, hãy trả về abstain."
)
#: Fixed: an extraction with fewer characters, or a smaller share of Vietnamese letters, is no usable text.
LEAST_CHARACTERS, LEAST_DIACRITICS = 500, 0.01
#: Fixed: what an attempt is told about an answer that can't be read, and the reason of a claim that the judge left out.
UNREADABLE, BROKEN, ODD, UNJUDGED = "output không đọc được: ", "Bộ sinh trả về JSON hỏng: ", "Bộ sinh trả về cấu trúc lạ: ", "judge không chấm mệnh đề này"


def clause_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def short_label(article_no: Column, clauses: Column, lead_in: Column) -> Column:
    """Article, and its clauses, or that it is the lead-in of an article that has clauses; clauses is a clause_range."""
    tail = F.when(lead_in, LEAD_IN).when(clauses == "0", "").otherwise(F.concat(F.lit(CLAUSE), clauses))
    return F.concat(F.lit(ARTICLE), article_no.cast("string"), tail)


def citation_label(title: Column, article_no: Column, clauses: Column, lead_in: Column) -> Column:
    return F.concat(short_label(article_no, clauses, lead_in), F.lit(" "), title)


def indexed_text(label: Column, article_title: Column, text: Column) -> Column:
    """What is indexed of a chunk: its label, the title of its article where there is one, and its text."""
    return F.concat(label, F.when(article_title != "", F.concat(F.lit(" — "), article_title)).otherwise(""), F.lit("\n"), text)


def chunk_id(doc_id: Column, article_no: Column, clauses: Column, part: Column) -> Column:
    return F.format_string("%s#a%s#c%s#p%s", doc_id.cast("string"), article_no.cast("string"), clauses, part.cast("string"))


def candidate_digest(indexed_texts: Column) -> Column:
    """SHA-256 over the candidates' indexed texts in order, a line each."""
    return F.sha2(F.array_join(indexed_texts, "\n"), 256)


def key_preview(canonical_input: Column) -> Column:
    return F.substring(canonical_input, 1, 200)


def extraction_problem(text: Column) -> Column:
    """Null for a usable text, else what is wrong with it."""
    return F.when(F.length(text) < LEAST_CHARACTERS, "too short").when(diacritic_ratio(text) < LEAST_DIACRITICS, "too few diacritics")


def context(chunks: Column, with_document: bool = False) -> Column:
    """Chunks (label, title, doc_id, status, effective_to, text; in order) as numbered blocks."""

    def block(c: Column, i: Column) -> Column:
        valid = F.concat(c["status"], F.when(F.coalesce(c["effective_to"], F.lit("")) != "", F.concat(F.lit(", hết hiệu lực "), c["effective_to"])).otherwise(""))
        said = F.concat(F.lit("văn bản: "), c["doc_id"], F.lit(" · hiệu lực: "), valid) if with_document else F.concat(F.lit("hiệu lực: "), valid)
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["label"], F.lit(" — "), c["title"], F.lit("\n    "), said, F.lit("\n"), strip(c["text"]))

    return F.array_join(F.transform(chunks, block), "\n\n")


def _marks(citations: Column, separator: str) -> Column:
    return F.array_join(F.transform(citations, lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), separator)


def claims_text(claims: Column) -> Column:
    """Claims (text, citations) as numbered lines for a judge."""
    said = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["text"], F.lit("  (viện dẫn: "), _marks(c["citations"], ", "), F.lit(")"))
    return F.array_join(F.transform(claims, said), "\n")


def answer_text(claims: Column) -> Column:
    """Each claim with its citations after it."""
    return F.array_join(F.transform(claims, lambda c: strip(F.concat(c["text"], F.lit(" "), _marks(c["citations"], "")))), " ")


def answer_labels(claims: Column, labels: Column) -> Column:
    """The cited chunks' labels by ordinal, each once; ordinals without a chunk are left out."""
    used = F.array_sort(F.array_distinct(F.flatten(F.transform(claims, lambda c: c["citations"]))))
    known = F.filter(used, lambda o: (o >= 1) & (o <= F.size(labels)))
    return F.transform(known, lambda o: F.concat(F.lit("["), o.cast("string"), F.lit("] "), F.get(labels, o - 1)))


def retry_feedback(problems: Column, rejected: Column) -> Column:
    """What a second attempt is told; problems: of citations; rejected: struct (text, reason) of unsupported claims."""
    first = F.when(F.size(problems) > 0, F.concat(F.array(F.lit(WRONG_CITATIONS)), F.transform(problems, lambda p: F.concat(F.lit("- "), p)))).otherwise(_none())
    said = F.transform(rejected, lambda r: F.concat(F.lit('- "'), r["text"], F.lit('" — '), r["reason"]))
    second = F.when(F.size(rejected) > 0, F.concat(F.array(F.lit(UNSUPPORTED)), said)).otherwise(_none())
    return F.array_join(F.concat(first, second, F.array(F.lit(MEND))), "\n")


def _none() -> Column:
    return F.array().cast("array<string>")


def quoted(text: Column) -> Column:
    """A text as a quoted literal: single quotes unless only those occur in it; backslashes, line ends and tabs escaped."""
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(plain), F.lit(escaped))
    inner = F.when(single & double, F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body)
    mark = F.when(single & ~double, '"').otherwise("'")
    return F.concat(mark, inner, mark)


def draft(raw: Column) -> Column:
    """struct (abstain, reason, claims) of a draft's JSON object; null where it can't be read.

    Claims without text go; citations that are no integers go, others stay, in range or not, for the check to find.
    """
    value = F.try_parse_json(raw)
    none = F.expr("cast(array() as array<struct<text:string,citations:array<bigint>>>)")
    numbers = lambda c: F.filter(F.transform(F.coalesce(elements(member(c, "citations")), F.array().cast("array<variant>")), integer), lambda x: x.isNotNull())
    made = F.transform(F.filter(elements(member(value, "claims")), is_object), lambda c: F.struct(strip(text_of(member(c, "text"))).alias("text"), numbers(c).alias("citations")))
    abstain = truthy(member(value, "abstain"))
    claims = F.when(~abstain, F.filter(F.coalesce(made, none), lambda c: c["text"] != "")).otherwise(none)
    reason = F.when(abstain, text_of(member(value, "reason"))).otherwise("")
    return F.when(is_object(value), F.struct(abstain.alias("abstain"), reason.alias("reason"), claims.alias("claims")))


def draft_problem(raw: Column) -> Column:
    """What is wrong with a draft that can't be read, null where it can."""
    value = F.try_parse_json(raw)
    said = F.concat(F.lit(UNREADABLE), F.when(value.isNull(), BROKEN).otherwise(ODD), quoted(F.substring(raw, 1, 200)))
    return F.when(~is_object(value), said)


def verdicts(raw: Column, n_claims: Column) -> Column:
    """array of struct (claim_id, supported, reason), one for each claim of 1 to n_claims that has one, the last one holding.

    Null where the answer is broken or no list.
    """
    items = F.filter(listed(json_body(raw), "verdicts"), is_object)
    read = F.transform(items, lambda v: F.struct(integer(member(v, "claim_id")).cast("int").alias("claim_id"), truthy(member(v, "supported")).alias("supported"), text_of(member(v, "reason")).alias("reason")))
    return last_of_each(F.filter(read, lambda v: v["claim_id"].between(1, n_claims)), "claim_id")


def judged(found: Column, n_claims: Column) -> Column:
    """A verdict for each claim of 1 to n_claims, in order; those that the judge left out aren't supported."""
    left_out = lambda k: F.struct(k.alias("claim_id"), F.lit(False).alias("supported"), F.lit(UNJUDGED).alias("reason"))
    every = F.sequence(F.lit(1), n_claims)
    return F.when(found.isNotNull() & (n_claims > 0), F.transform(every, lambda k: F.coalesce(F.get(F.filter(found, lambda v: v["claim_id"] == k), F.lit(0)), left_out(k))))
