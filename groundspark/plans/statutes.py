"""Raw texts to bodies, selection, outline and audit; documents' lines, marked by their number, stand in for statutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.operators import chunking, gold, normalize, structure
from groundspark.plans.retrieval import read

_ROMAN = ("I", "II", "III", "IV")


def _marked(line: Column, i: Column) -> Column:
    """Lines become chapters, sections, articles, clauses, points, page numbers or tails by their number and length; others stay."""
    n = F.length(line)
    number = lambda c: c.cast("string")
    third = F.floor(i / 3).cast("long")
    return (
        F.when(i % 24 == 2, F.concat(F.lit("Chương "), F.element_at(F.array(*map(F.lit, _ROMAN)), (F.floor(i / 24) % 4 + 1).cast("int"))))
        .when(i % 24 == 3, line)
        .when(i % 24 == 12, F.concat(F.lit("Mục "), number(F.floor(i / 24).cast("long") + 1)))
        .when((i > 30) & (n % 13 == 0), F.lit("Nơi nhận: x"))
        .when(i % 3 == 1, F.concat(F.lit(" Điều "), number(third + n % 2), F.lit(". "), line))
        .when(i % 6 == 5, F.concat(number(n % 3 + 1), F.lit(". "), line))
        .when(i % 6 == 0, F.concat(F.lit("b) "), line))
        .when(n % 5 == 0, number(i))
        .otherwise(line)
    )


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _marked)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def _kinds(warnings: str) -> Column:
    return F.array_join(F.transform(warnings, lambda w: F.concat_ws(":", w["kind"], w["detail"])), "|")


def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.normalized(_statutes(spark, sf_dir))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_lines_joined", "n_lines_dropped", "n_chapters", "n_articles", "n_clauses")]
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat_ws("->", g["a"].cast("string"), g["b"].cast("string"))), ",")
    kinds = F.array_join(F.transform("warnings", lambda w: w["kind"]), ",")
    return found.select("doc_id", *counts, gaps.alias("gaps"), kinds.alias("warnings"), F.sha2("body", 256).alias("body_sha256"))


def q_select_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _statutes(spark, sf_dir).withColumnRenamed("text", "body")
    wanted = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("article_no")).where((F.col("article_no") + F.col("doc_id")) % 3 == 0)
    found = normalize.select_articles(docs, wanted)
    return found.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"))


def q_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.outline(_statutes(spark, sf_dir).withColumnRenamed("text", "body"))
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2(F.coalesce("chapter", F.lit("")), 256).alias("chapter_sha256"), "article_no", F.sha2("title", 256).alias("title_sha256"), F.col("n_clauses").cast("long").alias("n_clauses"), F.col("n_tokens").cast("long").alias("n_tokens"), _kinds("warnings").alias("warnings"))


def q_corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three lines stand in for chunks, each reaching into the next; the kept list asks for some articles that aren't there."""
    docs = _statutes(spark, sf_dir).withColumnRenamed("text", "body")
    lines = structure.lines(docs)
    chunks = lines.where("ln % 3 != 0").join(docs.select("doc_id", F.length("body").alias("_n")), "doc_id")
    chunks = chunks.select("doc_id", F.col("s").cast("long").alias("s"), F.least(F.col("e") + 15, F.col("_n")).cast("long").alias("e"), (F.length("line") + 1).alias("n_tokens"))
    articles = normalize.outline(docs).select("doc_id", "article_no")
    wanted = docs.where("doc_id % 4 != 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 5 + 1)).alias("article_no"))
    found = gold.corpus_audit(docs, articles, chunks, wanted)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("doc_id", "n_articles", "n_chunks", F.round("median_tokens", 4).alias("median_tokens"), F.round("coverage", 6).alias("coverage"), listed("missing"), listed("extra"))


def q_statute_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _statutes(spark, sf_dir).withColumnRenamed("text", "body")
    lines = structure.lines(docs)
    found = structure.articles(lines)
    clauses = structure.clauses(lines, found)
    longs = [F.col(c).cast("long").alias(c) for c in ("article_seq", "article_no", "clause_no", "s", "e")]
    return clauses.select("doc_id", *longs)


def q_statute_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the derived statutes, with their texts' digests; whole text under articles is covered, or reading fails."""
    docs = _statutes(spark, sf_dir).withColumnRenamed("text", "body")
    lines = structure.lines(docs)
    found = structure.articles(lines)
    made = chunking.chunks(structure.clauses(lines, found), docs, found)
    return made.select("doc_id", "chunk_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("n_tokens").cast("long").alias("n_tokens"), "is_lead_in", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"statute_clauses": q_statute_clauses, "statute_chunks": q_statute_chunks, "normalize": q_normalize, "select_articles": q_select_articles, "outline": q_outline, "corpus_audit": q_corpus_audit}

_T = """src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
src_l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM src),
t AS (SELECT doc_id, i, CASE WHEN i % 24 = 2 THEN 'Chương ' || ['I', 'II', 'III', 'IV'][i // 24 % 4 + 1] WHEN i % 24 = 3 THEN x WHEN i % 24 = 12 THEN 'Mục ' || (i // 24 + 1)
  WHEN i > 30 AND length(x) % 13 = 0 THEN 'Nơi nhận: x' WHEN i % 3 = 1 THEN ' Điều ' || (i // 3 + length(x) % 2) || '. ' || x WHEN i % 6 = 5 THEN (length(x) % 3 + 1) || '. ' || x
  WHEN i % 6 = 0 THEN 'b) ' || x WHEN length(x) % 5 = 0 THEN i::VARCHAR ELSE x END AS line FROM src_l)"""
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_ST = f"trim(line, {_WS})"
_HEAD = r"'^(Chương\s+[IVXLCDM]+|Mục\s+\d+|Điều\s+\d+\.)'"
_STRUCT = r"'^(Chương\s+[IVXLCDM]+|Mục\s+\d+|Điều\s+\d+\.|\d+\.\s|[a-zđ]\)\s)'"
_FIXES = "translate(nfc_normalize(line), chr(160) || '‘’‚‛“”„‟–—‒―' || chr(65279) || chr(173), ' ''''''''\"\"\"\"----')"
SQL = {
    "statute_clauses": rf"""WITH RECURSIVE {_T}, l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, {_ST} AS st FROM t),
n AS (SELECT doc_id, i, s, s + length(rtrim(line, ' ')) AS e, st, CASE WHEN regexp_matches(st, '^Điều\s+\d+\.') THEN 'article' WHEN regexp_matches(st, '^(Chương\s+([IVXLCDM]+|\d+)|Mục\s+\d+)\s*$') THEN 'heading' END AS kind FROM l WHERE st <> ''),
u AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS unit, count_if(kind = 'article') OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seq FROM n),
a AS (SELECT doc_id, unit, seq, regexp_extract(st, '^Điều\s+(\d+)\.', 1)::BIGINT AS no FROM u WHERE kind = 'article'),
b AS (SELECT u.doc_id, a.seq, a.no, u.i, u.s, u.e, try_cast(regexp_extract(st, '^(\d+)\.\s', 1) AS BIGINT) AS k, lag(u.e) OVER w AS before, row_number() OVER w AS r FROM u JOIN a USING (doc_id, unit) WHERE kind IS NULL WINDOW w AS (PARTITION BY doc_id, a.seq ORDER BY i)),
z AS (SELECT doc_id, seq, no, min(s) AS first, max(e) AS last FROM b GROUP BY ALL),
x AS (SELECT p.doc_id, p.seq, p.i, p.k, min(q.i) AS following FROM b p JOIN b q ON q.doc_id = p.doc_id AND q.seq = p.seq AND q.i > p.i AND q.k = p.k + 1 WHERE p.k IS NOT NULL GROUP BY ALL),
rec AS (SELECT doc_id, seq, 1::BIGINT AS k, min(i) AS i FROM b WHERE k = 1 GROUP BY doc_id, seq UNION ALL SELECT rec.doc_id, rec.seq, rec.k + 1, x.following FROM rec JOIN x ON x.doc_id = rec.doc_id AND x.seq = rec.seq AND x.i = rec.i AND x.k = rec.k),
c AS (SELECT rec.doc_id, rec.seq, rec.k, b.s, b.before FROM rec JOIN b ON b.doc_id = rec.doc_id AND b.seq = rec.seq AND b.i = rec.i),
w AS (SELECT doc_id, seq, k, s, before FROM c UNION ALL SELECT z.doc_id, z.seq, 0, first, NULL FROM z LEFT JOIN c ON c.doc_id = z.doc_id AND c.seq = z.seq AND c.k = 1 WHERE c.s IS NULL OR c.s > first)
SELECT w.doc_id, w.seq::BIGINT AS article_seq, z.no AS article_no, k AS clause_no, w.s, coalesce(lead(before) OVER (PARTITION BY w.doc_id, w.seq ORDER BY k), last)::BIGINT AS e FROM w JOIN z ON z.doc_id = w.doc_id AND z.seq = w.seq""",
    "normalize": rf"""WITH {_T}, c AS (SELECT doc_id, i, {_FIXES} AS line FROM t), s AS (SELECT *, {_ST} AS st FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, st) AS times FROM s),
o AS (SELECT doc_id, count(*) AS raw, count_if(st <> '' AND times > 3) > 0 AS often, count_if((st <> '' AND times > 3) OR regexp_matches(st, '^\d+$')) AS noise FROM n GROUP BY doc_id),
k AS (SELECT doc_id, i, line, st, lag(st) OVER w AS before FROM n WHERE NOT ((st <> '' AND times > 3) OR regexp_matches(st, '^\d+$')) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
j AS (SELECT *, coalesce(st <> '' AND before <> '' AND NOT regexp_matches(st, {_STRUCT}) AND NOT regexp_matches(before, {_HEAD}) AND NOT regexp_matches(before, '[.;:!?]$'), false) AS joins FROM k),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM j),
u AS (SELECT doc_id, g, count_if(joins) AS joined, rtrim(regexp_replace(string_agg(CASE WHEN joins THEN st ELSE rtrim(line, {_WS}) END, ' ' ORDER BY i), '[ \t]+', ' ', 'g'), {_WS}) AS line FROM g GROUP BY doc_id, g),
q AS (SELECT *, {_ST} AS st FROM (SELECT *, line <> '' OR coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY g), 'x') <> '' AS stays FROM u)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS j, count(*) OVER (PARTITION BY doc_id) AS total FROM q WHERE stays),
a AS (SELECT *, min(CASE WHEN regexp_matches(st, '^(Chương\s+[IVXLCDM]+|Điều\s+1\.)') THEN j END) OVER (PARTITION BY doc_id) AS start FROM r),
z AS (SELECT *, min(CASE WHEN j >= coalesce(start, 1) AND regexp_matches(st, '^(Nơi nhận|PHỤ LỤC|Phụ lục|Biểu mẫu)([^\p{{L}}\p{{N}}_]|$)|^_{{5,}}') THEN j END) OVER (PARTITION BY doc_id) AS tail FROM a),
b AS (SELECT * FROM z WHERE j >= coalesce(start, 1) AND (tail IS NULL OR j < tail)),
m AS (SELECT doc_id, j, no, lag(no) OVER (PARTITION BY doc_id ORDER BY j) AS last FROM (SELECT doc_id, j, regexp_extract(st, '^Điều\s+(\d+)\.', 1)::BIGINT AS no FROM b WHERE regexp_matches(st, '^Điều\s+\d+\.'))),
e AS (SELECT doc_id, string_agg(last || '->' || no, ',' ORDER BY j) FILTER (no <> last + 1) AS gaps, count(*) AS articles FROM m GROUP BY doc_id),
f AS (SELECT doc_id, count_if(regexp_matches(st, '^Chương\s+[IVXLCDM]+')) AS chapters, count_if(regexp_matches(st, '^\d+\.\s')) AS clauses, trim(string_agg(line, chr(10) ORDER BY j), {_WS}) || chr(10) AS body FROM b GROUP BY doc_id),
d AS (SELECT doc_id, max(start) AS start, max(tail) AS tail, max(total) AS total FROM z GROUP BY doc_id), jn AS (SELECT doc_id, sum(joined) AS joined FROM u GROUP BY doc_id)
SELECT o.doc_id, coalesce(joined, 0)::BIGINT AS n_lines_joined, (noise + coalesce(start - 1, 0) + coalesce(total - tail + 1, 0))::BIGINT AS n_lines_dropped, coalesce(chapters, 0)::BIGINT AS n_chapters, coalesce(articles, 0)::BIGINT AS n_articles,
  coalesce(clauses, 0)::BIGINT AS n_clauses, coalesce(gaps, '') AS gaps, concat_ws(',', CASE WHEN often THEN 'repeated_lines' END, CASE WHEN start IS NULL THEN 'no_start' END, CASE WHEN tail IS NOT NULL THEN 'cut_tail' END,
  CASE WHEN coalesce(articles, 0) = 0 THEN 'no_article' END, CASE WHEN gaps IS NOT NULL THEN 'article_gaps' END) AS warnings, sha256(coalesce(body, chr(10))) AS body_sha256
FROM o LEFT JOIN jn USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "select_articles": rf"""WITH {_T}, s AS (SELECT *, {_ST} AS st FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(st, '^Chương\s+[IVXLCDM]+') THEN 'chapter' WHEN regexp_matches(st, '^Mục\s+\d+') THEN 'section' WHEN regexp_matches(st, '^Điều\s+\d+\.') THEN 'article' END AS kind FROM s),
u AS (SELECT *, count(kind) OVER w AS unit, count_if(kind = 'chapter') OVER w AS ch, count_if(kind IN ('chapter', 'section')) OVER w AS se FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, first_value(kind) OVER (PARTITION BY doc_id, unit ORDER BY i) AS of, min(CASE WHEN kind IS NULL AND (st = '' OR regexp_matches(st, {_STRUCT})) THEN i END) OVER (PARTITION BY doc_id, unit) AS stop FROM u WHERE unit > 0),
b AS (SELECT doc_id, unit, any_value(of) AS of, min(ch) AS ch, min(se) AS se, string_agg(line, chr(10) ORDER BY i) AS text, string_agg(line, chr(10) ORDER BY i) FILTER (stop IS NULL OR i < stop) AS block, regexp_extract(min_by(st, i), '^Điều\s+(\d+)\.', 1) AS no FROM h GROUP BY doc_id, unit),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch ORDER BY unit) = 1 AS first_ch, row_number() OVER (PARTITION BY doc_id, se ORDER BY unit) = 1 AS first_se FROM b WHERE of = 'article' AND (no::BIGINT + doc_id) % 3 = 0 AND no::BIGINT <= 60),
p AS (SELECT doc_id, unit, 2 AS level, text || chr(10) AS piece FROM a UNION ALL SELECT a.doc_id, a.unit, 0, chr(10) || b.block || chr(10) || chr(10) FROM a JOIN b ON b.doc_id = a.doc_id AND b.ch = a.ch AND b.of = 'chapter' WHERE first_ch
  UNION ALL SELECT a.doc_id, a.unit, 1, chr(10) || b.block || chr(10) || chr(10) FROM a JOIN b ON b.doc_id = a.doc_id AND b.se = a.se AND b.of = 'section' WHERE first_se),
o AS (SELECT doc_id, trim(string_agg(piece, '' ORDER BY unit, level), {_WS}) || chr(10) AS body FROM p GROUP BY doc_id)
SELECT doc_id, length(coalesce(body, chr(10)))::BIGINT AS n_chars, sha256(coalesce(body, chr(10))) AS body_sha256 FROM documents LEFT JOIN o USING (doc_id)""",
    "outline": rf"""WITH {_T}, s AS (SELECT *, {_ST} AS st FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(st, '^Chương\s+[IVXLCDM]+') THEN 'chapter' WHEN regexp_matches(st, '^Điều\s+\d+\.') THEN 'article' END AS kind FROM s),
x AS (SELECT doc_id, i, lead(st) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM k WHERE st <> ''),
c AS (SELECT k.*, CASE WHEN kind = 'chapter' THEN st || CASE WHEN following IS NULL OR regexp_matches(following, {_STRUCT}) THEN '' ELSE ' — ' || following END END AS label FROM k LEFT JOIN x USING (doc_id, i)),
u AS (SELECT *, count(kind) OVER w AS unit, last_value(label IGNORE NULLS) OVER w AS chapter FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT doc_id, unit, first(kind ORDER BY i) AS of, first(chapter ORDER BY i) AS chapter, first(st ORDER BY i) AS head, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kind IS NULL), '') AS body,
  coalesce(list(try_cast(regexp_extract(st, '^(\d+)\.\s', 1) AS BIGINT) ORDER BY i) FILTER (kind IS NULL AND regexp_matches(st, '^\d+\.\s')), []) AS cl FROM u WHERE unit > 0 GROUP BY doc_id, unit),
a AS (SELECT *, greatest(1, round(length(body) / 3.5))::BIGINT AS n_tokens FROM b WHERE of = 'article')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS seq, sha256(coalesce(chapter, '')) AS chapter_sha256, regexp_extract(head, '^Điều\s+(\d+)\.', 1)::BIGINT AS article_no, sha256(trim(regexp_extract(head, '^Điều\s+\d+\.\s*(.*)$', 1), {_WS})) AS title_sha256,
  len(cl)::BIGINT AS n_clauses, n_tokens, concat_ws('|', CASE WHEN len(cl) = 0 THEN 'no_clauses:' WHEN cl <> range(1, len(cl) + 1) THEN 'clause_order:[' || array_to_string(cl, ', ') || ']' END, CASE WHEN n_tokens > 2000 THEN 'long:' || n_tokens END) AS warnings FROM a""",
    "corpus_audit": rf"""WITH {_T}, d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM t GROUP BY doc_id),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, {_ST} AS st FROM t),
c AS (SELECT doc_id, s, least(s + length(rtrim(line, ' ')) + 15, length(body)) AS e, length(line) + 1 AS n FROM l JOIN d USING (doc_id) WHERE i % 3 <> 0),
p AS (SELECT doc_id, s, e, n, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM c),
g AS (SELECT doc_id, count(*) AS n_chunks, median(n)::DOUBLE AS m, sum(greatest(0, e - greatest(s, reach))) AS covered FROM p GROUP BY doc_id),
a AS (SELECT doc_id, regexp_extract(st, '^Điều\s+(\d+)\.', 1)::BIGINT AS no FROM l WHERE regexp_matches(st, '^Điều\s+\d+\.')), ac AS (SELECT doc_id, count(*) AS n_articles FROM a GROUP BY doc_id),
w AS (SELECT doc_id, unnest(range(1, doc_id % 5 + 2)) AS no FROM d WHERE doc_id % 4 <> 0),
mi AS (SELECT doc_id, string_agg(no::VARCHAR, ',' ORDER BY no) AS missing FROM (SELECT * FROM w EXCEPT SELECT * FROM a) GROUP BY doc_id),
ex AS (SELECT doc_id, string_agg(no::VARCHAR, ',' ORDER BY no) AS extra FROM (SELECT * FROM a WHERE doc_id % 4 <> 0 EXCEPT SELECT * FROM w) GROUP BY doc_id)
SELECT doc_id, coalesce(n_articles, 0)::BIGINT AS n_articles, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(round(m, 4), 0.0) AS median_tokens, CASE WHEN length(body) > 0 THEN round(coalesce(covered, 0) / length(body), 6) ELSE 0.0 END AS coverage,
  coalesce(missing, '') AS missing, coalesce(extra, '') AS extra FROM d LEFT JOIN g USING (doc_id) LEFT JOIN ac USING (doc_id) LEFT JOIN mi USING (doc_id) LEFT JOIN ex USING (doc_id)""",
}
