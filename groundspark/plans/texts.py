"""Token, line and JSON queries over documents, benchmark and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.json import canonical, digest
from groundspark.functions.text import bag, jaccard, nfc, squeeze_blanks, token_estimate, tokens, word_count
from groundspark.operators import structure
from groundspark.operators.intervals import interval_union, locate
from groundspark.plans.retrieval import _words, read
from groundspark.sources.tables import materialized, spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(_docs(spark, sf_dir).withColumnRenamed("text", "body"))


def q_tokenize_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(nfc(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(bag(words)).cast("long").alias("n_terms"), F.sha2(F.array_join(bag(words), " "), 256).alias("terms_sha256"))


def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", token_estimate(F.col("text")).cast("long").alias("n_tokens"), F.length(squeeze_blanks(F.col("text"))).cast("long").alias("tidy_chars"))


def q_token_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("lang", token_estimate(F.coalesce("text", F.lit(""))).alias("n"))
    p = lambda x: F.round(F.percentile("n", F.lit(x)), 4)
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.min("n").cast("long").alias("least"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"), F.max("n").cast("long").alias("most"))


def q_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", word_count(F.col("text")).cast("long").alias("n_words"))


def q_jaccard_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's words against all documents; the highest overlap and where it is."""
    sets = lambda table, key, name: materialized(_words(read(spark, sf_dir, table), key, name).select(name, F.array_distinct("words").alias(f"{name}_w")))
    q, d = sets("benchmark", "item_id", "q"), sets("documents", "doc_id", "d")
    each = lambda rows, name: rows.select(name, F.size(f"{name}_w").alias(f"n{name}"), F.explode_outer(f"{name}_w").alias("w")).where("w is not null")
    words = each(q, "q").join(each(d, "d"), "w")
    common = words.groupBy("q", "d", "nq", "nd").agg(F.count("*").alias("n"))
    scored = common.select("q", "d", F.round(F.col("n") / (F.col("nq") + F.col("nd") - F.col("n")), 6).alias("jaccard"))
    best = scored.groupBy("q").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "d")).alias("b"))
    return best.select(F.col("q").alias("item_id"), F.col("b.d").alias("doc_id"), (-F.col("b.j")).alias("jaccard"), (-F.col("b.j") > 0.3).alias("leaks"))


def q_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document with the offsets of their first and last characters."""
    found = _lines(spark, sf_dir)
    return found.select("doc_id", F.col("ln").cast("long").alias("ln"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def q_structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by kind, and under which heading they stand; short lines play headings here."""
    heading = F.when((F.length("line") > 0) & (F.length("line") <= 60), F.col("line"))
    headed = structure.with_headings(_lines(spark, sf_dir), heading, "heading")
    return headed.groupBy("doc_id", structure.kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"), F.count("heading").alias("headed"), F.count_distinct("heading").alias("headings"))


def q_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = structure.drop_noise(_lines(spark, sf_dir))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).cast("long").alias("chars"))


def q_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("line != ''").groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 3").select(F.sha2("line", 256).alias("line_sha256"), "n", "docs")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from lines: some reach into the next lines, some leave gaps."""
    return _lines(spark, sf_dir).select("doc_id", "ln", F.col("s").cast("long").alias("s"), (F.col("e") + F.col("ln") % 3 * 20 - 10).cast("long").alias("e"))


def q_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_union(_spans(spark, sf_dir).select("doc_id", "s", "e"), ["doc_id"])


def q_point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds each document's middle character, if any."""
    points = _docs(spark, sf_dir).select("doc_id", F.floor(F.length("text") / 2).cast("long").alias("pos"))
    return locate(points, _lines(spark, sf_dir).select("doc_id", "ln", "s", "e")).select("doc_id", "pos", F.col("ln").cast("long").alias("ln"))


def q_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    parsed = F.from_json("props", "map<string,string>")
    return events.select("event_id", F.coalesce(F.size(parsed), F.lit(0)).cast("long").alias("n_keys"), F.array_join(F.array_sort(F.map_keys(parsed)), ",").alias("keys"))


def q_cache_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select("event_id", digest(canonical(task=F.col("event_type"), input=F.col("user_id"), version=F.lit("v1"))).alias("digest"))


def q_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose view events have no recorded purchase: the anti join of asked against recorded."""
    events = read(spark, sf_dir, "events").select("event_type", digest(F.col("user_id").cast("string")).alias("digest"))
    asked = events.groupBy("digest").agg(F.count("*").alias("asked"))
    recorded = events.where("event_type = 'purchase'")
    return asked.join(recorded.select("digest"), "digest", "left_anti")


_T = "regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[0-9]+|[\\p{L}\\p{Nl}\\p{No}]+')"
_LINES = """
parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM parts),
lines AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM each),
numbered AS (SELECT *, s + length(rtrim(line, ' ')) AS e FROM lines)"""
_STRIP = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"

QUERIES = {
    "tokenize_bag": q_tokenize_bag, "token_estimate": q_token_estimate, "token_percentiles": q_token_percentiles, "word_count": q_word_count,
    "jaccard_leakage": q_jaccard_leakage, "line_offsets": q_line_offsets, "structure_lines": q_structure_lines, "noise_lines": q_noise_lines,
    "repeated_lines": q_repeated_lines, "interval_union": q_interval_union, "point_in_interval": q_point_in_interval, "json_parse": q_json_parse,
    "cache_digest": q_cache_digest, "cache_miss": q_cache_miss,
}
SQL = {
    "tokenize_bag": f"""WITH t AS (SELECT doc_id, {_T} AS u FROM documents),
b AS (SELECT doc_id, list_concat(u, [concat_ws('_', u[i], u[i + 1]) FOR i IN range(1, len(u))]) AS terms FROM t)
SELECT doc_id, len(terms)::BIGINT AS n_terms, sha256(array_to_string(terms, ' ')) AS terms_sha256 FROM b""",
    "token_estimate": f"""WITH {_LINES}, q AS (SELECT doc_id, ln, rtrim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)) AS t FROM numbered),
k AS (SELECT doc_id, t, t <> '' OR coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY ln), 'first') <> '' AS kept FROM q),
n AS (SELECT doc_id, (sum(length(t)) + count(*) - 1)::BIGINT AS tidy_chars FROM k WHERE kept GROUP BY doc_id)
SELECT doc_id, greatest(1, round(length(coalesce(text, '')) / 3.5))::BIGINT AS n_tokens, tidy_chars FROM documents JOIN n USING (doc_id)""",
    "token_percentiles": """WITH t AS (SELECT lang, greatest(1, round(length(coalesce(text, '')) / 3.5))::BIGINT AS n FROM documents)
SELECT lang, count(*) AS docs, min(n) AS least, round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.5), 4) AS median, round(quantile_cont(n, 0.75), 4) AS p75, max(n) AS most FROM t GROUP BY lang""",
    "word_count": "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'))::BIGINT AS n_words FROM documents",
    "jaccard_leakage": f"""WITH q AS (SELECT item_id, list_distinct({_T}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({_T}) AS w FROM documents),
c AS (SELECT item_id, doc_id, len(q.w) AS nq, len(d.w) AS nd, len(list_intersect(q.w, d.w)) AS n FROM q, d),
s AS (SELECT item_id, doc_id, round(n::DOUBLE / (nq + nd - n), 6) AS jaccard FROM c WHERE n > 0)
SELECT item_id, doc_id, jaccard, jaccard > 0.3 AS leaks FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id) AS r FROM s) WHERE r = 1""",
    "line_offsets": f"WITH {_LINES} SELECT doc_id, ln, s, e FROM numbered",
    "structure_lines": f"""WITH {_LINES},
h AS (SELECT *, last_value(CASE WHEN length(line) BETWEEN 1 AND 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS heading FROM numbered)
SELECT doc_id, CASE WHEN regexp_matches({_STRIP}, '^(\\d+)\\.\\s') THEN 'clause' WHEN regexp_matches({_STRIP}, '^[a-zđ]\\)\\s') THEN 'point' ELSE 'text' END AS kind,
count(*) AS n, count(heading) AS headed, count(DISTINCT heading) AS headings FROM h GROUP BY ALL""",
    "noise_lines": f"""WITH {_LINES}, c AS (SELECT *, {_STRIP} AS t, count(*) OVER (PARTITION BY doc_id, {_STRIP}) AS n FROM numbered)
SELECT doc_id, count(*) AS kept, sum(length(line))::BIGINT AS chars FROM c WHERE t = '' OR (n <= 3 AND NOT regexp_matches(t, '^\\d+$')) GROUP BY doc_id""",
    "repeated_lines": f"WITH {_LINES} SELECT sha256(line) AS line_sha256, count(*) AS n, count(DISTINCT doc_id) AS docs FROM numbered WHERE line != '' GROUP BY line HAVING count(*) > 3",
    "interval_union": f"""WITH {_LINES}, v AS (SELECT doc_id, s, e + ln % 3 * 20 - 10 AS e FROM numbered WHERE s < e + ln % 3 * 20 - 10),
f AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT doc_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM g GROUP BY doc_id, i""",
    "point_in_interval": f"""WITH {_LINES}, p AS (SELECT doc_id, (length(coalesce(text, '')) // 2)::BIGINT AS pos FROM documents)
SELECT p.doc_id, pos, ln FROM p LEFT JOIN numbered n ON n.doc_id = p.doc_id AND n.s <= pos AND pos < n.e""",
    "json_parse": "SELECT event_id, coalesce(len(json_keys(props)), 0)::BIGINT AS n_keys, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "cache_digest": """SELECT event_id, sha256('{"input":' || user_id || ',"task":' || to_json(event_type) || ',"version":"v1"}') AS digest FROM events""",
    "cache_miss": """WITH e AS (SELECT event_type, sha256(user_id::VARCHAR) AS digest FROM events)
SELECT digest, count(*) AS asked FROM e WHERE digest NOT IN (SELECT digest FROM e WHERE event_type = 'purchase') GROUP BY digest""",
}
