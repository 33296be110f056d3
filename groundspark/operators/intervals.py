"""Half-open intervals on a document's axis: unions, overlaps, coverage, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_union(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e): empty and inverted intervals dropped, overlapping and adjacent ones merged (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = intervals.where("s < e").withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def coverage(spans: DataFrame, ranked: DataFrame, depth: int) -> DataFrame:
    """(qid, span_ix, k, cov): the share of each gold span that the first k ranked chunks cover, for k up to depth.

    spans (qid, span_ix, doc_id, s, e) meet ranked (qid, rank, doc_id, s, e) on query and document; a span's overlaps
    are cut to the span, put under every k that they count for, and merged.
    """
    chunk = ranked.where(F.col("rank") <= depth).select("qid", "doc_id", "rank", F.col("s").alias("cs"), F.col("e").alias("ce"))
    cut = spans.join(chunk, ["qid", "doc_id"]).select(
        "qid", "span_ix", "rank", F.greatest("s", "cs").alias("s"), F.least("e", "ce").alias("e"), (F.col("e") - F.col("s")).alias("len")
    )
    by_k = cut.where("s < e").withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(depth))))
    merged = interval_union(by_k.select("qid", "span_ix", "k", "s", "e"), ["qid", "span_ix", "k"])
    covered = merged.groupBy("qid", "span_ix", "k").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    every = spans.select("qid", "span_ix", (F.col("e") - F.col("s")).alias("len"), F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("k"))
    share = F.when(F.col("len") > 0, F.coalesce(F.col("covered"), F.lit(0)) / F.col("len")).otherwise(0.0)
    return every.join(covered, ["qid", "span_ix", "k"], "left").select("qid", "span_ix", "k", share.alias("cov"))


def question_results(curve: DataFrame, theta: float = 0.8) -> DataFrame:
    """(qid, k, strict, any_hit, mean_cov, r_star): all or any spans covered to theta, and the first k with all.

    r_star is null when a span never gets there.
    """
    first = curve.groupBy("qid", "span_ix").agg(F.min(F.when(F.col("cov") >= theta, F.col("k"))).alias("r"))
    star = first.groupBy("qid").agg(F.when(F.count("r") == F.count("*"), F.max("r")).alias("r_star"))
    hit = F.col("cov") >= theta
    each = curve.groupBy("qid", "k").agg(F.every(hit).alias("strict"), F.some(hit).alias("any_hit"), F.avg("cov").alias("mean_cov"))
    return each.join(star, "qid")


def retrieval_report(results: DataFrame, types: DataFrame, ks: list[int]) -> DataFrame:
    """Recall, coverage and MRR by question type and overall (type null), as macro means over questions."""
    rows = results.where(F.col("k").isin(ks)).join(types, "qid")
    return rows.rollup("k", "type").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("strict").cast("int")), 4).alias("recall_strict"),
        F.round(F.avg(F.col("any_hit").cast("int")), 4).alias("recall_any"),
        F.round(F.avg("mean_cov"), 4).alias("mean_cov"),
        F.round(F.avg(F.coalesce(1 / F.col("r_star"), F.lit(0.0))), 4).alias("mrr"),
    ).where("k is not null")


def locate(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (doc_id, pos) with the span (doc_id, s, e, ...) that contains each; null in gaps."""
    p, q = points.alias("p"), spans.alias("q")
    on = (F.col("p.doc_id") == F.col("q.doc_id")) & (F.col("q.s") <= F.col("p.pos")) & (F.col("p.pos") < F.col("q.e"))
    return p.join(q, on, "left").select("p.*", *(F.col(f"q.{c}") for c in spans.columns if c != "doc_id"))
