"""Corpus files with frontmatter, question files, recorded model answers, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.functions.json import digest
from groundspark.functions.text import line_feeds, nfc, scalar, strip

REQUIRED = ("doc_id", "title", "doc_type", "issued_date", "effective_from", "status")
STATUSES = ("active", "expired")
FRONT = "(?s)\\A---[ \\t]*\\n(.*?)\\n---[ \\t]*\\n"


#: Fixed: what a line of the frontmatter looks like, tested on a stripped line.
KEY_VALUE = r"(?s)^([A-Za-z_][A-Za-z0-9_]*)\s*:\s*(.*)$"


def parse_frontmatter(raw: DataFrame) -> DataFrame:
    """(source, meta map, body, problem) of raw (source, text): key: value lines; blank lines and # comments are skipped.

    The last of repeated keys holds; problem names a missing frontmatter, a bad line with its number in the file, the
    missing keys or a bad status.
    """
    text = line_feeds(F.regexp_replace("text", "^\ufeff+", ""))
    front = raw.select("source", text.alias("text")).withColumn("front", F.regexp_extract("text", FRONT, 1))
    numbered = F.transform(F.split("front", "\n", -1), lambda x, i: F.struct(strip(x).alias("line"), (i + 2).alias("no")))
    front = front.withColumn("rows", F.filter(numbered, lambda x: (x["line"] != "") & ~F.startswith(x["line"], F.lit("#"))))
    bad = F.get(F.filter("rows", lambda x: ~x["line"].rlike(KEY_VALUE)), F.lit(0))
    pairs = F.transform(F.filter("rows", lambda x: x["line"].rlike(KEY_VALUE)), lambda x: F.struct(F.regexp_extract(x["line"], KEY_VALUE, 1).alias("k"), scalar(F.regexp_extract(x["line"], KEY_VALUE, 2)).alias("v")))
    front = front.withColumns({"bad": bad, "pairs": pairs})
    last = F.filter("pairs", lambda x, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda y: y["k"] == x["k"]))
    parsed = front.withColumn("meta", F.map_from_entries(last))
    missing = F.filter(F.array(*(F.lit(k) for k in REQUIRED)), lambda k: F.coalesce(F.try_element_at("meta", k), F.lit("")) == "")
    problem = (
        F.when(~F.col("text").rlike(FRONT), "no frontmatter")
        .when(F.col("bad").isNotNull(), F.concat(F.lit("bad line "), F.col("bad.no").cast("string"), F.lit(": "), F.col("bad.line")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
        .when(~F.try_element_at("meta", F.lit("status")).isin(*STATUSES), F.concat(F.lit("bad status "), F.try_element_at("meta", F.lit("status"))))
    )
    return parsed.select("source", "meta", nfc(F.regexp_replace("text", FRONT, "")).alias("body"), problem.alias("problem"))


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, meta fields, body, source and problem of all .txt files of a folder, doc_ids that occur twice being a problem of each.

    A folder without such files raises FileNotFoundError, one that isn't there Spark's error, both before anything runs.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[tT][xX][tT]")
    if not raw.inputFiles():
        raise FileNotFoundError(f"no .txt file in {folder}")
    parsed = parse_frontmatter(raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")))
    of = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    rows = parsed.select(*map(of, ("doc_id", *REQUIRED[1:], "effective_to")), "body", "source", "problem")
    twice = F.when((F.count("*").over(Window.partitionBy("doc_id")) > 1) & F.col("doc_id").isNotNull(), F.concat(F.lit("repeated doc_id "), "doc_id"))
    return rows.withColumn("problem", F.coalesce("problem", twice))


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, meta fields and body of all .txt files of a folder, by doc_id; a problem of any file raises when rows are read."""
    rows = corpus_files(spark, folder)
    fine = F.when(F.col("problem").isNull(), F.col("doc_id")).otherwise(F.raise_error(F.concat_ws(": ", "source", "problem")).cast("string"))
    return rows.withColumn("doc_id", fine).drop("source", "problem").orderBy("doc_id")


def quarantined_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What `load_corpus` gives of the files without a problem, and (source, problem) of the others."""
    rows = corpus_files(spark, folder)
    return rows.where("problem is null").drop("source", "problem").orderBy("doc_id"), rows.where("problem is not null").select("source", "problem")


QUESTION = "qid string, question string, type string, answerable boolean, gold_spans array<struct<doc_id:string,char_start:int,char_end:int>>, gold_answer string"


def load_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and their gold spans (qid, span_ix, doc_id, s, e)."""
    rows = spark.read.schema(QUESTION).json(path, multiLine=True)
    spans = rows.select("qid", F.posexplode("gold_spans").alias("span_ix", "x")).select("qid", "span_ix", "x.doc_id", F.col("x.char_start").alias("s"), F.col("x.char_end").alias("e"))
    return rows.drop("gold_spans"), spans


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, response) of recorded model calls, one JSON file each, named by the digest of its key."""
    rows = spark.read.schema("response string, created_at string").json(folder, multiLine=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]{64})\\.json$", 1).alias("digest"), "response")


def misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys (digest, ...) without a recorded answer."""
    return keys.join(cache.select("digest"), "digest", "left_anti")


def keyed(calls: DataFrame, payload: str = "payload") -> DataFrame:
    return calls.withColumn("digest", digest(F.col(payload)))


def frontmatter(docs: DataFrame) -> Column:
    """The frontmatter of docs' rows, keys in fixed order: null for null, bare words as they are, other values quoted; what can't be read back raises."""
    keys = (*REQUIRED[:5], "effective_to", "status")
    value = lambda k: F.col(k).cast("string") if k in docs.columns else F.lit(None).cast("string")
    written = lambda v: F.when(v.isNull(), "null").when(v.rlike("^[A-Za-z0-9_]+\\z"), v).otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit("'")), F.lit('"')))
    text = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), written(value(k))) for k in keys), F.lit("---"))
    missing = F.filter(F.array(*(F.when(F.coalesce(value(k), F.lit("")) == "", F.lit(k)) for k in REQUIRED)), lambda k: k.isNotNull())
    fail = lambda *said: F.raise_error(F.concat(*said)).cast("string")
    return F.when(F.size(missing) > 0, fail(F.lit("missing: "), F.array_join(missing, ","))).when(~value("status").isin(*STATUSES), fail(F.lit("bad status "), value("status"))).otherwise(text)


def write_corpus(docs: DataFrame, folder: str) -> None:
    """One text for each document (doc_id, meta fields, body): frontmatter, a blank line, the stripped body and a line feed, under file=<doc_id>."""
    text = F.concat(frontmatter(docs), F.lit("\n\n"), strip(F.col("body")))
    docs.select(text.alias("value"), F.col("doc_id").alias("file")).write.partitionBy("file").mode("overwrite").text(folder)


def detect_format(files: DataFrame) -> DataFrame:
    """path and format (pdf, doc, docx or unknown) of binaryFile rows, by first bytes, then by suffix."""
    starts = lambda x: F.startswith(F.col("content"), F.lit(x))
    suffix = F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1))
    kind = F.when(starts(b"%PDF"), "pdf").when(starts(b"\xd0\xcf\x11\xe0"), "doc").when(starts(b"PK\x03\x04"), "docx")
    return files.select("path", kind.when(suffix.isin("pdf", "doc", "docx"), suffix).otherwise("unknown").alias("format"))
