"""Reports in folders: each table as JSON lines in a fixed order, written by Spark's task commit and read back with the schema it was written with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a table is ordered by, where it has these columns.
ORDER = ("arm", "tau_r", "tau_g", "doc_id", "char_start", "chunk_id", "qid", "type", "k")


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table to folder/name, ordered by its ORDER columns, nulls written out, and its schema to folder/name.schema."""
    for name, table in tables.items():
        keys = [c for c in ORDER if c in table.columns]
        ordered = table.orderBy(*keys) if keys else table
        ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
        schema = table.sparkSession.createDataFrame([(table.schema.json(),)], "value string")
        schema.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.schema")


def read_report(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The tables of a report as they were written."""
    kinds = {name: T.StructType.fromJson(json.loads(spark.read.text(f"{folder}/{name}.schema").first()["value"])) for name in names}
    return {name: spark.read.schema(kinds[name]).json(f"{folder}/{name}") for name in names}


_CLAIM = "struct<text:string,citations:array<int>>"
_ATTEMPT = (
    f"struct<attempt:int,draft:struct<abstain:boolean,reason:string,claims:array<{_CLAIM}>>,check_a:struct<ok:boolean,problems:array<string>>,"
    "check_b:struct<support_ratio:double,verdicts:array<struct<claim_index:int,supported:boolean,reason:string>>>>"
)
ANSWERS = (
    "arm string, tau_retrieve double, tau_ground double, questions array<struct<qid:string,type:string,answerable:boolean,question:string,answer:string,citations:array<string>,abstained:boolean,"
    f"abstain_stage:string,retrieval_score:double,support_ratio_first:double,support_ratio_final:double,attempts:array<{_ATTEMPT}>>>"
)


def answers_file(spark: SparkSession, path: str) -> DataFrame:
    """The questions of an answers report in one JSON file, with its arm and thresholds in each row and the columns of `answer_report`.

    Such a file is one value, so one task reads it; reports of `write_report` have no such bound. A file that isn't there raises.
    """
    rows = spark.read.schema(ANSWERS).json(path, multiLine=True)
    each = rows.select("arm", F.col("tau_retrieve").alias("tau_r"), F.col("tau_ground").alias("tau_g"), F.explode("questions").alias("q"))
    same = ("qid", "question", "type", "answerable", "answer", "citations", "abstained")
    return each.select("arm", "tau_r", "tau_g", *(F.col(f"q.{c}").alias(c) for c in same), F.col("q.abstain_stage").alias("stage"), "q.retrieval_score", F.col("q.support_ratio_first").alias("ratio_first"), F.col("q.support_ratio_final").alias("ratio_final"), F.size("q.attempts").alias("n_attempts"), F.col("q.attempts").alias("attempts"))
