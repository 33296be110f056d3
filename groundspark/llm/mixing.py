"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import free_names, full_text, n_words, prepare, row_key, written

#: Sources in code point order, null last, take these weights in turn.
WEIGHTS = (3, 1, 2)
#: What the mix holds, as a share of all words; and how often a source may be repeated at most.
SHARE, EPOCHS = 1.5, 2
SEED = "mix-1"


def prefix_sums(df: DataFrame, order: list[Column], value: str, group: str | None = None) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same group that come earlier in order.

    Rows are sorted by range and written with their positions; each range's sum goes into an offset, and sums run
    within a range only, so that no group has to fit into one task. Groups are equal where null equals null.
    """
    own = F.struct(group) if group else F.lit(0)
    placed = df.withColumn("_group", own).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = placed.groupBy("_group", "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_group", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_group", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return run.join(parts, ["_group", "_part"]).withColumn("before", F.col("_run") + F.col("_offset")).drop("_group", "_part", "_at", "_run", "_offset")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) for sizes (source, source_size): each source's share by weight, epochs * size at most.

    The level at which weight * level is shared out rises until no source is above its limit; each step brings two
    sums to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1)), order, "one").drop("one")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = epochs * F.col("source_size")
    level, last = 0.0, -1.0
    while level != last:
        over = limit <= F.col("weight") * F.lit(level)
        spent, left = ranked.agg(F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        last, level = level, (share * total - (spent or 0)) / left if left else last if last > level else level
    return ranked.select("source", "source_size", F.least(limit.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mixed_words(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): size, source_size, target and the words the mix takes.

    Documents of a source are taken in hash-random order (by md5 of seed and doc_id, then doc_id, size and the text's
    md5): whole epochs first, then up to the exact budget, where one document is cut. A null text has size 0; null is a
    source of its own, the last; a null doc_id is kept; of repeated rows each counts; other columns are ignored; an
    empty table gives none.
    """
    prepare(docs.sparkSession)
    text = full_text()
    slim = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            n_words(text).alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("key"),
            F.md5(text).alias("digest"),
        )
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    order = [F.col(c) for c in ("source", "key", "doc_id", "size", "digest")]
    run = prefix_sums(slim, order, "size", "source")
    run = run.withColumn("_s", F.struct("source")).join(targets.select(F.struct("source").alias("_s"), "source_size", "target"), "_s").drop("_s")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return run.select("doc_id", "source", "digest", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: whole copies of each document and, at a source's cut, its first words.

    Words of a cut document are joined by one space. Repeated rows count as one document with as many copies.
    """
    columns = docs.columns
    name, words, size, turn, part = free_names(docs, "_key", "_taken", "_size", "_first", "_part")
    key = lambda: row_key(F.col("doc_id").cast("long"), F.col("source"), F.col("digest"))
    taken = mixed_words(docs, seed).groupBy(key().alias(name)).agg(F.sum("taken").alias(words), F.max("size").alias(size)).where(F.col(words) > 0)
    mine = docs.withColumn(name, row_key(F.col("doc_id").cast("long"), F.col("source"), F.md5(full_text())))
    joined = mine.join(taken, name).withColumn(turn, F.row_number().over(Window.partitionBy(name).orderBy(name))).where(F.col(turn) == 1)
    rest = (F.col(words) % F.col(size)).cast("int")
    whole = F.floor(F.col(words) / F.col(size)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<int>)")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)), F.lit(1), F.greatest(part, F.lit(1))), " ")
    out = joined.withColumn(part, F.explode(parts)).withColumn("text", F.when(F.col(part) < 0, F.col("text")).otherwise(cut))
    return out.select(*(F.col(f"`{c}`") for c in columns))



MIX_SQL = f"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)) AS key, md5(coalesce(text, '')) AS digest
  FROM documents),
sources AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source)),
steps AS (
  SELECT *, coalesce(sum(2 * source_size) OVER earlier, 0) AS spent,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS left_over
  FROM sources WINDOW earlier AS (ORDER BY 2.0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT max(level) AS level FROM (
    SELECT (1.5::DOUBLE * (SELECT sum(size)::DOUBLE FROM slim) - spent::DOUBLE) / left_over::DOUBLE AS level, source_size, weight FROM steps)
  WHERE weight * level <= 2 * source_size),
targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * coalesce(level, 0.0)) AS target FROM sources, levels),
run AS (
  SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size, digest ROWS UNBOUNDED PRECEDING) - size AS before
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM run
"""
