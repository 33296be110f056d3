"""Gold spans, leakage, structure kinds, misses and formats over rows in which every case occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.json import canonical, digest
from groundspark.operators import leakage, structure
from groundspark.plans.retrieval import read
from groundspark.plans.statutes import _ST, _T, _statutes
from groundspark.plans.texts import _T as _TOKENS
from groundspark.sources import corpus


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items as questions, one of seven unanswerable; two spans of documents each, some of them unknown or outside."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"), (F.col("item_id") % 7 != 6).alias("answerable"))
    doc = F.when(F.col("qid") % 11 == 3, -1 - F.col("qid")).otherwise(F.col("qid") * 3 + F.col("span_ix"))
    start = F.col("qid") * 7 % 90
    spans = items.select("qid", F.explode(F.array(F.lit(0), F.lit(1))).alias("span_ix")).select("qid", "span_ix", doc.alias("doc_id"), start.alias("s"), (start + F.when(F.col("qid") % 5 == 4, 100_000_000).otherwise(60 + F.col("span_ix") * 200)).alias("e"))
    return items, spans


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))


def q_question_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, spans = _questions(spark, sf_dir)
    scores, left_out = leakage.question_leakage(items, spans, _bodies(spark, sf_dir))
    rows = scores.select("qid", F.round("score", 6).alias("score"), "leaks", F.lit(None).cast("string").alias("left_out"))
    return rows.unionByName(left_out.select("qid", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("leaks"), F.col("reason").alias("left_out")))


def q_validated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three lines of a document stand in for an article, its lines for clauses."""
    _, spans = _questions(spark, sf_dir)
    bodies = _bodies(spark, sf_dir)
    lines = structure.lines(bodies).where("e > s")
    seq = F.floor(F.col("ln") / 3).cast("long") + 1
    clauses = lines.select("doc_id", seq.alias("article_seq"), seq.alias("article_no"), (F.col("ln") % 3).cast("long").alias("clause_no"), "s", "e")
    found = leakage.validated_spans(spans, bodies, clauses)
    return found.select("qid", F.col("span_ix").cast("long").alias("span_ix"), "problem", "label", F.sha2("preview", 256).alias("preview_sha256"))


def q_structure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.lines(_statutes(spark, sf_dir).withColumnRenamed("text", "body"))
    return lines.groupBy("doc_id", structure.kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"), F.sum("ln").cast("long").alias("places"))


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("digest", digest(canonical(user=F.col("user_id"), type=F.col("event_type"))))


def q_recorded_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that users asked for and that no event with a number divisible by 3 recorded."""
    events = _keyed(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    asked = events.groupBy("digest").agg(F.count("*").alias("asked"))
    return corpus.misses(asked, events.where("event_id % 3 = 0").select("digest").distinct())


def q_format_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under first bytes and suffixes that agree, contradict each other or tell nothing."""
    starts = F.array(*(F.lit(b) for b in (b"%PDF-1.7", b"\xd0\xcf\x11\xe0\xa1\xb1", b"PK\x03\x04", b"", b"PK")))
    suffix = F.array(*map(F.lit, (".pdf", ".DOCX", ".doc", ".html", "", ".tar.PDF")))
    i = F.col("page_id").cast("int")
    files = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.get(suffix, i % 6)).alias("path"), F.concat(F.get(starts, i % 5), F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("content"))
    return corpus.detect_format(files).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), "format")


QUERIES = {
    "question_leakage": q_question_leakage, "validated_spans": q_validated_spans, "structure_kinds": q_structure_kinds, "recorded_misses": q_recorded_misses, "format_kinds": q_format_kinds,
}

_SPANS = """q AS (SELECT item_id AS qid, coalesce(text, '') AS question, item_id % 7 <> 6 AS answerable FROM benchmark), b AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT qid, ix, CASE WHEN qid % 11 = 3 THEN -1 - qid ELSE qid * 3 + ix END AS doc_id, qid * 7 % 90 AS s, qid * 7 % 90 + CASE WHEN qid % 5 = 4 THEN 100000000 ELSE 60 + ix * 200 END AS e FROM q, (SELECT unnest([0, 1]) AS ix)),
p AS (SELECT s.*, body, CASE WHEN body IS NULL THEN 'unknown document' WHEN e > length(body) THEN 'outside of the document' END AS problem FROM s LEFT JOIN b USING (doc_id))"""
SQL = {
    "question_leakage": f"""WITH {_SPANS}, g AS (SELECT qid, string_agg(substr(body, s + 1, e - s), chr(10) ORDER BY ix) AS text FROM p WHERE problem IS NULL GROUP BY qid),
w AS (SELECT qid, list_distinct({_TOKENS.replace("coalesce(text, '')", "question")}) AS a, list_distinct({_TOKENS}) AS b FROM q JOIN g USING (qid) WHERE answerable),
j AS (SELECT qid, len(list_intersect(a, b)) AS n, len(a) AS x, len(b) AS y FROM w), r AS (SELECT qid, CASE WHEN x = 0 OR y = 0 THEN 0.0 ELSE n / (x + y - n)::DOUBLE END AS score FROM j)
SELECT qid, round(score, 6) AS score, score > 0.3 AS leaks, NULL::VARCHAR AS left_out FROM r
UNION ALL SELECT qid, NULL, NULL, 'span ' || ix || ': ' || problem FROM p JOIN q USING (qid) WHERE answerable AND problem IS NOT NULL
UNION ALL SELECT qid, NULL, NULL, 'no usable span' FROM q WHERE answerable AND qid NOT IN (SELECT qid FROM g)""",
    "validated_spans": f"""WITH {_SPANS}, parts AS (SELECT doc_id, string_split(body, chr(10)) AS ls FROM b), each AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM parts),
n AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cs FROM each),
c AS (SELECT doc_id, ln // 3 + 1 AS seq, ln % 3 AS no, cs, cs + length(rtrim(line, ' ')) AS ce FROM n WHERE rtrim(line, ' ') <> ''),
h AS (SELECT doc_id, seq, min(cs) AS lo, max(ce) AS hi, max(no) AS most FROM c GROUP BY ALL),
f AS (SELECT p.qid, p.ix, min(h.seq) AS seq FROM p JOIN h ON h.doc_id = p.doc_id AND h.lo <= p.s AND p.e <= h.hi WHERE problem IS NULL GROUP BY ALL),
o AS (SELECT p.*, f.seq, h.most, (SELECT max(no) FROM c WHERE c.doc_id = p.doc_id AND c.seq = f.seq AND c.cs <= p.s AND p.s < c.ce) AS no FROM p LEFT JOIN f USING (qid, ix) LEFT JOIN h ON h.doc_id = p.doc_id AND h.seq = f.seq)
SELECT qid, ix::BIGINT AS span_ix, coalesce(problem, CASE WHEN seq IS NULL THEN 'in no single article' END) AS problem,
  CASE WHEN seq IS NOT NULL THEN 'Điều ' || seq || CASE WHEN no = 0 AND most > 0 THEN ' (đoạn mở đầu)' WHEN coalesce(no, 0) = 0 THEN '' ELSE ' Khoản ' || no END END AS label,
  CASE WHEN seq IS NOT NULL THEN sha256(replace(substr(body, s + 1, least(e - s, 120)), chr(10), ' ') || CASE WHEN e - s > 120 THEN '…' ELSE '' END) END AS preview_sha256 FROM o""",
    "structure_kinds": rf"""WITH {_T}, k AS (SELECT doc_id, i, {_ST} AS st FROM t)
SELECT doc_id, CASE WHEN regexp_matches(st, '^Chương\s+([IVXLCDM]+|\d+)$') THEN 'chapter' WHEN regexp_matches(st, '^Mục\s+\d+$') THEN 'section' WHEN regexp_matches(st, '^Điều\s+\d+\.') THEN 'article' WHEN regexp_matches(st, '^\d+\.\s') THEN 'clause'
  WHEN regexp_matches(st, '^[a-zđ]\)\s') THEN 'point' ELSE 'text' END AS kind, count(*) AS n, sum(i)::BIGINT AS places FROM k GROUP BY ALL""",
    "recorded_misses": """WITH e AS (SELECT event_id, sha256('{"type":' || to_json(event_type) || ',"user":' || user_id || '}') AS digest FROM events)
SELECT digest, count(*) AS asked FROM e WHERE digest NOT IN (SELECT digest FROM e WHERE event_id % 3 = 0) GROUP BY digest""",
    "format_kinds": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx' ELSE CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'doc' WHEN 5 THEN 'pdf' ELSE 'unknown' END END AS format FROM pages""",
}
